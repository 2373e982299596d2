"""First contents of the dimensions, loaded without repeating what is there."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The category tree, parents with their children.
CATEGORY_TREE = {
    "Food & Dining": ["Restaurants", "Groceries", "Food Delivery", "Coffee"],
    "Transportation": ["Fuel", "Cab/Auto", "Public Transport", "Parking"],
    "Shopping": ["Clothing", "Electronics", "Home & Garden"],
    "Utilities": ["Electricity", "Mobile/Internet", "Water", "Gas"],
    "Entertainment": ["Movies", "Subscriptions", "Games"],
    "Health": ["Medical", "Pharmacy", "Gym/Fitness"],
    "Housing": ["Rent", "Maintenance", "Furniture"],
    "Travel": ["Flights", "Hotels", "Activities"],
    "Personal": ["Gifts", "Personal Care", "Education"],
    "Financial": ["Transfers", "Investments", "Insurance", "Fees"],
    "Income": ["Salary", "Reimbursements", "Refunds", "Interest"],
    "Uncategorized": [],
}

# Starter rules as (name, text in the description, category id of the tree above).
STARTER_RULES = [
    ("Swiggy Food Delivery", "SWIGGY", 4), ("Zomato Food Delivery", "ZOMATO", 4), ("Dunzo Delivery", "DUNZO", 4),
    ("Uber Rides", "UBER", 8), ("Ola Rides", "OLA", 8), ("Rapido Rides", "RAPIDO", 8),
    ("BPCL Fuel", "BPCL", 7), ("HPCL Fuel", "HPCL", 7), ("Indian Oil", "IOCL", 7), ("Shell Fuel", "SHELL", 7),
    ("Amazon Shopping", "AMAZON", 11), ("Flipkart Shopping", "FLIPKART", 11),
    ("Myntra Fashion", "MYNTRA", 12), ("Ajio Fashion", "AJIO", 12),
    ("Big Bazaar", "BIGBAZAAR", 3), ("DMart", "DMART", 3), ("More Supermarket", "MORE", 3),
    ("Reliance Fresh", "RELIANCE FRESH", 3),
    ("Reliance Digital", "RELIANCE DIGITAL", 13), ("Croma", "CROMA", 13),
    ("Netflix", "NETFLIX", 22), ("Amazon Prime", "PRIME", 22), ("Disney+ Hotstar", "HOTSTAR", 22),
    ("Spotify", "SPOTIFY", 22), ("BookMyShow", "BOOKMYSHOW", 21), ("PVR Cinemas", "PVR", 21),
    ("Airtel Mobile", "AIRTEL", 17), ("Vodafone", "VODAFONE", 17), ("Jio", "JIO", 17),
    ("Electricity Bill", "ELECTRICITY", 16), ("Gas Bill", "GAS", 19),
    ("MakeMyTrip", "MAKEMYTRIP", 27), ("Goibibo", "GOIBIBO", 27), ("IRCTC Railway", "IRCTC", 27),
    ("IndiGo", "INDIGO", 27), ("SpiceJet", "SPICEJET", 27),
    ("PayTM", "PAYTM", 34), ("PhonePe", "PHONEPE", 34), ("Google Pay", "GPAY", 34), ("UPI Transfer", "UPI-", 34),
    ("Apollo Pharmacy", "APOLLO", 25), ("Medplus", "MEDPLUS", 25), ("1mg", "1MG", 25),
]

# Starter merchants as (name, text in the description, category id).
STARTER_MERCHANTS = [("Amazon", "AMAZON", 11), ("Zomato", "ZOMATO", 1), ("Swiggy", "SWIGGY", 1)]


def category_tree_frame(spark: SparkSession) -> DataFrame:
    rows = []
    for parent, children in CATEGORY_TREE.items():
        rows += [(parent, None)] + [(child, parent) for child in children]
    return spark.createDataFrame(rows, "name string, parent_name string")


def seed_dimension(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """The dimension after loading ``wanted`` (id, name, parent_name).

    Names that exist keep their row, others are added; then every wanted name points to its
    parent, found by name among old and new rows.  ``existing`` has (id, name, parent_id).
    """
    first = existing.groupBy("name").agg(F.min("id").alias("id"))
    added = wanted.join(first, "name", "left_anti").select("id", "name", F.lit(None).cast("long").alias("parent_id"))
    every = existing.unionByName(added)
    by_name = every.groupBy("name").agg(F.min("id").alias("id"))
    link = (
        wanted.filter(F.col("parent_name").isNotNull())
        .join(by_name.select("name", F.col("id").alias("child_id")), "name")
        .join(by_name.select(F.col("name").alias("parent_name"), F.col("id").alias("new_parent")), "parent_name")
        .select(F.col("child_id").alias("id"), "new_parent")
    )
    return every.join(link, "id", "left").select("id", "name", F.coalesce("new_parent", "parent_id").alias("parent_id"))
