
from cataloom.plans import delivery, intake, items, small  # registers their queries
