"""Items of several shapes, declared schemas, page texts and the cache by URL, against expectations and plain Python."""

import json
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from cataloom.functions import schema as S, text as T
from cataloom.functions.markup import referenced
from cataloom.operators import attributes as A, pages as P, shapes as H

ITEMS = [
    {"identity": {"manufacturer": " Fluke", "mfg_part_number": "87V", "category": "Electrical"}, "attributes": {"voltage_v": {"raw_value": "120V", "normalized_value": "120", "unit": "V", "confidence": 0.9, "evidence_snippet": " https://a.example/x "}, "color": {"raw_value": "red", "normalized_value": ""}}},
    {"sku_id": "Fluke-87-V", "category": "", "enriched_attributes": [{"field_name": "weight", "raw_value": "2 lbs", "normalized_value": " 2 ", "unit": "", "source_url": "http://b.example"}, "noise", {"field_name": "len", "raw_value": 0, "normalized_value": None, "unit": "mm"}]},
    {"manufacturer": "3M", "part_num": "775L", "enriched_attributes": [], "attributes": {"zeta": 5, "alpha": "x", "grit": {"raw_value": "P120", "field_name": "grit_code"}}},
    {"mfg": "", "sku_id": "", "attributes": 7},
    {"identity": {}, "attributes": []},
]


def shaped(spark, column):
    rows = [(i, json.dumps(x)) for i, x in enumerate(ITEMS)] + [(9, "{broken"), (10, "[1]"), (11, None)]
    df = spark.createDataFrame(rows, "row_id int, item string")
    return df if column == "string" else df.withColumn("item", F.try_parse_json("item"))


@pytest.mark.parametrize("column", ["string", "variant"])
def test_items_of_all_shapes(spark, column):
    got = {r.row_id: r for r in H.delivery_items(shaped(spark, column)).drop("item").collect()}
    identity = {i: (r.manufacturer, r.mfg_part_number, r.category, r.sku_id, r["shape"]) for i, r in got.items()}
    assert identity == {
        0: (" Fluke", "87V", "Electrical", " Fluke-87V", "record"),
        1: ("Fluke", "87-V", "General", "Fluke-87-V", "item"),
        2: ("3M", "775L", "General", "3M-775L", "item"),
        3: ("", "", "General", "", "item"),
        4: ("", "", "General", "-", "record"),
        9: ("", "", "General", "", "broken"),
        10: ("", "", "General", "", "broken"),
        11: ("", "", "General", "", "broken"),
    }
    attrs = {i: [tuple(a) for a in r.attrs] for i, r in got.items()}
    first = [("voltage_v", "120", "V", " https://a.example/x "), ("color", "red", None, None)]
    assert attrs[0] == (first if column == "string" else sorted(first))
    assert attrs[1] == [("weight", " 2 ", None, "http://b.example"), ("len", "", "mm", None)]
    third = [("zeta", "5", None, None), ("alpha", "x", None, None), ("grit_code", "P120", None, None)]
    assert attrs[2] == (third if column == "string" else [third[1], third[2], third[0]])
    assert all(attrs[i] == [] for i in (3, 4, 9, 10, 11))


def test_delivery_derives_and_trims(spark):
    rows = H.delivery_items(shaped(spark, "string")).drop("item")
    got = {r.row_id: r for r in A.delivery(rows).collect()}
    assert len(got[0]) == 253
    assert got[0]["SKU - MY_PART_NUMBER"] == " Fluke-87V" and got[0]["Product Name"] == "Fluke 87V" and got[0]["MFR URL"] == "https://a.example/x"
    assert got[0]["LONG_DESC1"] == "Voltage: 120 V; Color: red" and got[0]["COLOR"] == "red"
    assert (got[1]["WEIGHT"], got[1]["WEIGHT_UOM"], got[1]["LENGTH"], got[1]["LENGTH_UOM"], got[1]["ATTRIBUTE_UOM 2"]) == ("2", "lbs", "", "mm", "mm")
    assert (got[3]["SKU - MY_PART_NUMBER"], got[3]["Product Name"], got[3]["MOBILE_DESC"], got[3]["SHORT_DESC"]) == ("", "", "General", "General Component")


def test_slots_without_value_and_missing_identity(spark):
    attrs = "array<struct<field_name:string,value:string,unit:string,source_url:string>>"
    rows = [(1, None, "P1", "HVAC", None, [("Length ", None, "mm", None), ("len", " 5 ", None, "ftp://x"), ("overall_length", "6", "in", "http://x")]), (2, "M", None, None, None, None)]
    got = A.delivery(spark.createDataFrame(rows, f"row_id int, manufacturer string, mfg_part_number string, category string, sku_id string, attrs {attrs}")).collect()
    assert (got[0]["LENGTH"], got[0]["LENGTH_UOM"], got[0]["Product Name"], got[0]["SHORT_DESC"], got[0]["MOBILE_DESC"], got[0]["SKU - MY_PART_NUMBER"], got[0]["MFR URL"]) == ("5", "in", "P1", "P1 HVAC Component", "HVAC, P1", "P1", "http://x")
    assert (got[1]["SKU - MY_PART_NUMBER"], got[1]["MOBILE_DESC"], got[1]["LONG_DESC1"]) == ("M", "M", "")


def test_coerced_attributes(spark):
    values = [["volts", "120V", None, "V", "x"], ["amps", "5", "5.0", None, 7, "http://u"], [None, "x"], ["usage", "1"], [" ", "1"], ["f"], 5, None, {"field_name": " w ", "raw_value": 3, "confidence": 0.5}, {"field_name": "h", "raw_value": "2", "normalized_value": None, "confidence_score": -1, "unit": "m"}, {"field_name": "k", "raw_value": None}]
    df = spark.createDataFrame([(json.dumps(values),), (None,)], "j string").select(H.coerced(F.from_json("j", "array<variant>"), F.lit("http://d")).alias("a"))
    got = [[tuple(a) for a in r.a] for r in df.collect()]
    assert got == [[("volts", "120V", "120V", "V", 0.9, "http://d"), ("amps", "5", "5.0", None, 1.0, "http://u"), ("w", "3", "3", None, 0.5, "http://d"), ("h", "2", "2", "m", 0.0, "http://d")], []]


# --- schemas

GOOD = {"manufacturer_name": "3M", "part_number": "775L", "category": "HVAC", "unknown": 1}


@pytest.mark.parametrize(
    "value, wrong",
    [
        (GOOD, []),
        (GOOD | {"raw_description": None}, []),
        (GOOD | {"raw_description": 5}, [("raw_description", "string_type", "5")]),
        ({"part_number": None, "category": "Toys"}, [("manufacturer_name", "missing", None), ("part_number", "string_type", "null"), ("category", "literal_error", '"Toys"')]),
        (GOOD | {"category": ["HVAC"]}, [("category", "string_type", '["HVAC"]')]),
        ([GOOD], [("", "object_type", json.dumps([GOOD], separators=(",", ":"), sort_keys=True))]),
        ("text", [("", "object_type", '"text"')]),
    ],
)
def test_request_schema(spark, value, wrong):
    [row] = spark.createDataFrame([(json.dumps(value),)], "j string").select(S.violations(F.col("j"), S.REQUEST).alias("v")).collect()
    assert [tuple(x) for x in row.v] == wrong


def test_response_schema_reaches_into_lists(spark):
    attribute = {"field_name": "f", "raw_value": "r", "normalized_value": "n", "source_url": "u"}
    value = {"sku_id": "s", "category": "c", "overall_confidence": "0.5", "processing_time_ms": -1, "enriched_attributes": [attribute, attribute | {"confidence_score": 1.5, "unit": 3}, 7]}
    df = spark.createDataFrame([(json.dumps(value),), ("{",), (None,)], "j string")
    got = [[tuple(x) for x in r.v] for r in df.select(S.violations(F.col("j"), S.RESPONSE).alias("v")).collect()]
    assert got[0] == [("enriched_attributes[1].unit", "string_type", "3"), ("enriched_attributes[1].confidence_score", "less_than_equal", "1.5"), ("enriched_attributes[2]", "object_type", "7"), ("processing_time_ms", "greater_than_equal", "-1")]
    assert got[1:] == [[("", "json_invalid", "{")], [("", "json_invalid", None)]]


def test_lengths_and_numbers(spark):
    fields = (S.Field("s", shortest=2, longest=3), S.Field("i", "int", least=1), S.Field("o", "object", fields=(S.Field("b", "bool"),)))
    rows = [{"s": "abc", "i": "4", "o": {"b": True}}, {"s": "a", "i": 0, "o": {"b": 1}}, {"s": "abcd", "i": 2.5, "o": []}]
    got = [[tuple(x)[:2] for x in r.v] for r in spark.createDataFrame([(json.dumps(x),) for x in rows], "j string").select(S.violations(F.col("j"), fields).alias("v")).collect()]
    assert got == [[], [("s", "string_too_short"), ("i", "greater_than_equal"), ("o.b", "bool_type")], [("s", "string_too_long"), ("i", "int_type"), ("o", "object_type")]]


def test_modes(spark):
    df = spark.createDataFrame([(1, json.dumps(GOOD)), (2, json.dumps({}))], "n int, j string")
    assert [len(r.errors) for r in S.validated(df, "j", S.REQUEST).orderBy("n").collect()] == [0, 3]
    assert [r.n for r in S.validated(df, "j", S.REQUEST, "DROPMALFORMED").collect()] == [1]
    with pytest.raises(Exception, match="manufacturer_name: missing"):
        S.validated(df, "j", S.REQUEST, "FAILFAST").collect()
    with pytest.raises(ValueError, match="mode"):
        S.validated(df, "j", S.REQUEST, "LAX")
    assert S.parsed(df, "j", S.REQUEST).orderBy("n").first()["part_number"] == "775L"


# --- pages


class Plain(HTMLParser):
    """The same reading of a page by Python's own parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.texts, self.fresh = [], [], True

    def handle_starttag(self, tag, attrs):
        self.fresh = True
        if tag not in "area base br col embed hr img input link meta param source track wbr".split():
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.fresh = True

    def handle_endtag(self, tag):
        self.fresh = True
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_comment(self, data):
        self.fresh = True

    def handle_data(self, data):
        if not {"script", "style", "noscript", "nav", "header", "footer"} & set(self.open):
            if self.fresh:
                self.texts.append("")
            self.texts[-1] += data
            self.fresh = False


def plain_text(page):
    parser = Plain()
    parser.feed((page or "")[:500_000])
    parser.close()
    lines = (line.strip() for line in "\n".join(parser.texts).splitlines())
    return "\n".join(line for line in lines if line)[:6000]


PAGES = [
    "<p>a<b>b</b>c</p>", "<nav>x<nav>y</nav>z</nav>k", '<img alt="x > y">t', "a < b <c>d", '<script>var a="</p>"; if(a<b){}</script>ok<style>p{}</style>',
    "<!-- x --><p>q", "<header><p>x</header>y", "</nav>z<br/>w<br>v", "<div><nav><div>a</div>", "<nav/>seen", "<HEADER>x</Header >y", "<p>a&nbsp;b</p>\n\n  <p> \t</p>c", "", None,
    "<noscript><img src=a></noscript>q", "&eacute;&#8217;&#x41;&amp;lt;&#128;&copy", "<div><footer>f<p>g</div>h", "x<div a='1>2' b=\">\" c>y</div>", "<p>" + "word &amp; " * 2000,
]


def test_page_text_is_what_a_parser_reads(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PAGES)], "i int, h string")
    got = [r.t for r in df.select("i", T.page_text(F.col("h")).alias("t")).orderBy("i").collect()]
    assert got == [plain_text(p) for p in PAGES]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.select("html", T.page_text(F.col("html")).alias("t")).collect():
        assert r.t == plain_text(r.html)


def test_character_references(spark):
    import html

    texts = ["&notit; &amp;amp; &unknown; &; & &#; &#x; &#0; &#xD800; &#9999999999; &#1114111; &#x1F600;", "&AMP &Amp; &ngE; &fjlig;&hellip;", "plain", ""]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(referenced(F.col("t"))).collect()]
    assert got[1:] == [html.unescape(t) for t in texts[1:]]
    assert got[0] == "¬it; &amp; &unknown; &; & &#; &#x; � � � \U0010ffff \U0001f600"


def test_fetched_pages(spark):
    rows = [("http://a/x", "<p>one</p>", "text/html", False), ("http://a/y.PDF", "%PDF", None, False), ("http://a/z", "%PDF", "application/pdf; q", False), ("http://a/f", "<p>two</p>", None, True), ("http://a/n", None, None, None), (None, "<p>three</p>", None, None)]
    df = spark.createDataFrame(rows, "url string, html string, kind string, bad boolean")
    got = [(r.outcome, r.raw_content) for r in P.fetched(df, F.col("kind"), F.col("bad"), F.lit("sheet")).collect()]
    assert got == [("html", "one"), ("pdf", "sheet"), ("pdf", "sheet"), ("failed", ""), ("failed", ""), ("html", "three")]


def test_scrape_cache_by_url(spark):
    rows = [(3, " http://a ", "Z", "P9", "Voltage: 5 V. " * 200), (2, "http://a", "Y", "P2", "Voltage: 7 V. " * 200), (1, "http://a", "X", "P1", ""), (4, "http://b", "B", "P4", "text b"), (5, "http://c", "C", "P5", None), (6, " ", "D", "P6", "own text"), (7, None, "D", "P7", None)]
    df = spark.createDataFrame(rows, "row_id int, url string, maker string, part string, raw_content string")
    cache = spark.createDataFrame([("http://b", "kept")], "url string, cleaned_text string").select(P.url_hash(F.col("url")).alias("url_hash"), "cleaned_text")
    texts, after = P.reduced_by_url(df, cache)
    got = {r.row_id: (r.cleaned_text, r.from_cache) for r in texts.collect()}
    assert got[1] == got[2] == got[3] and got[2][0].startswith("Voltage: 7 V.") and len(got[2][0]) <= 1500 and not got[2][1]
    assert got[4] == ("kept", True) and got[5] == ("", False) and got[6] == ("own text", False) and got[7] == ("", False)
    assert after.count() == 2
    again, last = P.reduced_by_url(df, after)
    assert {r.row_id for r in again.where("from_cache").collect()} == {1, 2, 3, 4} and last.count() == 2


def test_a_value_is_looked_up_once_for_all_checks(spark, capsys):
    """A text is parsed once, however many fields and checks its schema has."""
    spark.createDataFrame([("{}",)], "j string").select(S.violations(F.col("j"), S.RESPONSE).alias("v")).explain("extended")
    optimized = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("parseJson(") == 1 and optimized.count("$['sku_id']") == 1
