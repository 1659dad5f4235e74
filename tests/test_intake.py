"""Requests, fetched pages and answers on rows written by hand."""

from pyspark.sql import functions as F

from cataloom.functions import text as T
from cataloom.operators import answers as N, intake as I


def test_requests_fall_through_blank_cells(spark):
    rows = spark.createDataFrame([(1, " ", "Mirka (MIRUS)", None, "P-1", ""), (2, "Acme", "x", "D", "", "hvac")], "row_id long, Brand string, `Mfg Manuf` string, Description string, `Part-No` string, CATEGORY string")
    got = {r.row_id: tuple(r)[1:6] for r in I.api_requests(rows).collect()}
    assert got == {1: ("Mirka", "P-1", None, "General", "pending"), 2: ("Acme", "", "D", "hvac", "error")}
    assert I.api_requests(rows.where("row_id > 2").select("row_id")).count() == 0
    assert I.api_requests(rows.select("row_id")).first()["manufacturer_name"] == ""


def test_places_with_gaps_and_ranges(spark):
    rows = spark.createDataFrame([("b", 5), ("a", 250_000), ("a", 3), ("a", 99_999), ("b", 700_000), (None, 1)], "file string, pos long")
    got = {(r.file, r.pos): r.row_id for r in I.positional_ids(rows, "file", "pos").collect()}
    assert got == {(None, 1): 1, ("a", 3): 2, ("a", 99_999): 3, ("a", 250_000): 4, ("b", 5): 5, ("b", 700_000): 6}


def test_page_text(spark):
    html = "<html><NAV class=x><ul><li>menu</li></ul></NAV ><header>top</header><p>A <b>bold</b>&nbsp;</p><!-- no --><noscript>n</noscript><script>1<2</script>&lt;x&gt;\n\n <footer>f</footer></html>"
    rows = spark.createDataFrame([(html,), (None,), ("",)], "h string")
    assert [r.t for r in rows.select(T.page_text(F.col("h")).alias("t")).collect()] == ["A\nbold\n<x>", "", ""]


def test_context_keys_hosts_and_errors(spark):
    one = spark.range(1)
    context = I.combined_sources(F.lit(" d "), F.array(F.lit(None).cast("string"), F.lit(" "), F.lit("s\n")))
    none = I.combined_sources(F.lit(None).cast("string"), F.lit(None).cast("array<string>"))
    errors = N.with_error(F.lit(None), F.lit("E"), F.lit("m"), F.lit("s"))
    hosts = [T.allowed_host(F.lit(h), (), ("a.com",)) for h in ("a.com", "x.a.com", "ba.com")]
    row = one.select(context.alias("c"), none.alias("n"), T.key_list(F.lit(" 'a', \"b\",, ' '")).alias("k"), F.size(errors).alias("e"), F.array(*hosts).alias("h")).first()
    assert (row.c, row.n, row.k, row.e, row.h) == ("d\n\ns", "", ["a", "b"], 1, [True, True, False])


def test_reserved_names_go(spark):
    rows = spark.createDataFrame([(1, " Usage "), (1, "id"), (1, "voltage")], "row_id long, field_name string")
    assert [r.field_name for r in N.unreserved(rows).collect()] == ["voltage"]
