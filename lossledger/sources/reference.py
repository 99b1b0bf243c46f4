"""Literal reference tables of the claims model.

FIXED VALUES: every list below must equal the source application's values
for results to agree (line-of-business list, catastrophe events, the state
to region map, loss-cause categories, the expense budget by severity, the
seed-data vocabularies and the weather proxy-city map). They are stated
plainly, in their natural order, and are only ever turned into tiny
DataFrames that Spark broadcasts (the row counts are fixed, so the
broadcast size is bounded by construction).
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

D = _dt.date

# ---------------------------------------------------------------------------
# FIXED VALUES — line of business (id, name, lead, category)
# ---------------------------------------------------------------------------
LINES_OF_BUSINESS = [
    (1, "Auto Liability", "John Martinez", "Personal Lines"),
    (2, "Auto Physical Damage", "Sarah Chen", "Personal Lines"),
    (3, "Homeowners", "Michael Thompson", "Personal Lines"),
    (4, "Renters Insurance", "Emily Rodriguez", "Personal Lines"),
    (5, "Commercial Auto", "David Kim", "Commercial Lines"),
    (6, "General Liability", "Jennifer Walsh", "Commercial Lines"),
    (7, "Workers Compensation", "Robert Garcia", "Commercial Lines"),
    (8, "Professional Liability", "Lisa Patel", "Commercial Lines"),
    (9, "Product Liability", "James Wilson", "Commercial Lines"),
    (10, "Commercial Property", "Amanda Foster", "Commercial Lines"),
    (11, "Umbrella/Excess", "Christopher Lee", "Specialty Lines"),
    (12, "Marine Cargo", "Michelle Santos", "Specialty Lines"),
    (13, "Cyber Liability", "Daniel Brooks", "Specialty Lines"),
    (14, "Directors & Officers", "Rachel Green", "Specialty Lines"),
    (15, "Medical Malpractice", "Kevin OBrien", "Specialty Lines"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — catastrophe events
# (id, code, name, type, event date, end date, impacted states, industry loss)
# ---------------------------------------------------------------------------
CATASTROPHES = [
    (1, "CAT-2020-001", "Hurricane Laura", "Hurricane", D(2020, 8, 27), D(2020, 8, 28), "LA,TX", 10000000000),
    (2, "CAT-2020-002", "California Wildfires 2020", "Wildfire", D(2020, 8, 15), D(2020, 11, 15), "CA", 12500000000),
    (3, "CAT-2021-001", "Texas Winter Storm Uri", "Winter Storm", D(2021, 2, 13), D(2021, 2, 17), "TX,OK,LA", 15000000000),
    (4, "CAT-2021-002", "Hurricane Ida", "Hurricane", D(2021, 8, 29), D(2021, 9, 1), "LA,MS,NY,NJ", 36000000000),
    (5, "CAT-2022-001", "Kentucky Tornado Outbreak", "Tornado", D(2022, 12, 10), D(2022, 12, 11), "KY,TN,IL", 5500000000),
    (6, "CAT-2022-002", "Hurricane Ian", "Hurricane", D(2022, 9, 28), D(2022, 9, 30), "FL,SC,NC", 50000000000),
    (7, "CAT-2023-001", "California Atmospheric River", "Flood", D(2023, 1, 1), D(2023, 1, 16), "CA", 8000000000),
    (8, "CAT-2023-002", "Hawaii Wildfires Maui", "Wildfire", D(2023, 8, 8), D(2023, 8, 11), "HI", 5600000000),
    (9, "CAT-2024-001", "Texas Panhandle Wildfire", "Wildfire", D(2024, 2, 26), D(2024, 3, 1), "TX,OK", 2000000000),
    (10, "CAT-2024-002", "Hurricane Helene", "Hurricane", D(2024, 9, 26), D(2024, 9, 28), "FL,GA,NC,SC", 35000000000),
    (11, "CAT-2024-003", "Midwest Derecho", "Severe Storm", D(2024, 7, 15), D(2024, 7, 16), "IL,OH,IN", 4000000000),
    (12, "CAT-2025-001", "Los Angeles Wildfires", "Wildfire", D(2025, 1, 7), D(2025, 1, 20), "CA", 30000000000),
    (13, "CAT-2025-002", "Gulf Coast Flooding", "Flood", D(2025, 5, 10), D(2025, 5, 15), "TX,LA", 6000000000),
    (14, "CAT-2025-003", "Northeast Ice Storm", "Winter Storm", D(2025, 12, 1), D(2025, 12, 5), "NY,PA,MA", 3500000000),
    (15, "CAT-2026-001", "Florida Severe Weather", "Severe Storm", D(2026, 2, 15), D(2026, 2, 18), "FL,GA", 4500000000),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — state code, state name, region (50 states)
# ---------------------------------------------------------------------------
STATES = [
    ("AL", "Alabama", "South"), ("AK", "Alaska", "West"), ("AZ", "Arizona", "West"),
    ("AR", "Arkansas", "South"), ("CA", "California", "West"), ("CO", "Colorado", "West"),
    ("CT", "Connecticut", "Northeast"), ("DE", "Delaware", "South"), ("FL", "Florida", "Southeast"),
    ("GA", "Georgia", "Southeast"), ("HI", "Hawaii", "West"), ("ID", "Idaho", "West"),
    ("IL", "Illinois", "Midwest"), ("IN", "Indiana", "Midwest"), ("IA", "Iowa", "Midwest"),
    ("KS", "Kansas", "Midwest"), ("KY", "Kentucky", "South"), ("LA", "Louisiana", "South"),
    ("ME", "Maine", "Northeast"), ("MD", "Maryland", "South"), ("MA", "Massachusetts", "Northeast"),
    ("MI", "Michigan", "Midwest"), ("MN", "Minnesota", "Midwest"), ("MS", "Mississippi", "South"),
    ("MO", "Missouri", "Midwest"), ("MT", "Montana", "West"), ("NE", "Nebraska", "Midwest"),
    ("NV", "Nevada", "West"), ("NH", "New Hampshire", "Northeast"), ("NJ", "New Jersey", "Northeast"),
    ("NM", "New Mexico", "West"), ("NY", "New York", "Northeast"), ("NC", "North Carolina", "Southeast"),
    ("ND", "North Dakota", "Midwest"), ("OH", "Ohio", "Midwest"), ("OK", "Oklahoma", "South"),
    ("OR", "Oregon", "West"), ("PA", "Pennsylvania", "Northeast"), ("RI", "Rhode Island", "Northeast"),
    ("SC", "South Carolina", "Southeast"), ("SD", "South Dakota", "Midwest"), ("TN", "Tennessee", "South"),
    ("TX", "Texas", "South"), ("UT", "Utah", "West"), ("VT", "Vermont", "Northeast"),
    ("VA", "Virginia", "South"), ("WA", "Washington", "West"), ("WV", "West Virginia", "South"),
    ("WI", "Wisconsin", "Midwest"), ("WY", "Wyoming", "West"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — loss cause, category, weather related, weather condition
# ---------------------------------------------------------------------------
LOSS_CAUSES = [
    ("Cyber Attack", "Professional/Cyber", False, None),
    ("Equipment Failure", "Mechanical/Product", False, None),
    ("Fire Damage", "Weather-Related", True, "Wildfire/Lightning"),
    ("Hail Damage", "Weather-Related", True, "Severe Storm"),
    ("Medical Injury", "Injury", False, None),
    ("Natural Disaster", "Weather-Related", True, "Multiple Weather Events"),
    ("Product Defect", "Mechanical/Product", False, None),
    ("Professional Error", "Professional/Cyber", False, None),
    ("Property Theft", "Crime", False, None),
    ("Slip and Fall", "Accident", False, None),
    ("Vandalism", "Crime", False, None),
    ("Vehicle Collision", "Accident", False, None),
    ("Water Damage", "Weather-Related", True, "Flood/Rain"),
    ("Wind Damage", "Weather-Related", True, "Hurricane/Tornado/Derecho"),
    ("Workplace Injury", "Injury", False, None),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — expense budget by severity (legal, adjustor, investigation,
# ULAE) and the default used for an unknown severity
# ---------------------------------------------------------------------------
EXPENSE_BUDGET = [
    ("Minor", 2000, 800, 500, 400),
    ("Moderate", 5000, 1500, 1500, 800),
    ("Significant", 12000, 3000, 4000, 1500),
    ("Severe", 25000, 5000, 8000, 2500),
    ("Catastrophic", 50000, 8000, 15000, 4000),
]
EXPENSE_BUDGET_DEFAULT = (5000, 1500, 1500, 800)

# ---------------------------------------------------------------------------
# FIXED VALUES — seed vocabularies (in generator order: value i is picked by
# `id % len(list)`)
# ---------------------------------------------------------------------------
SEVERITIES = ["Minor", "Moderate", "Significant", "Severe", "Catastrophic"]
# source priority -> severity (driver tables: orders.o_orderpriority)
PRIORITY_SEVERITY = [
    ("1-URGENT", "Catastrophic"),
    ("2-HIGH", "Severe"),
    ("3-MEDIUM", "Significant"),
    ("4-NOT SPECIFIED", "Moderate"),
    ("5-LOW", "Minor"),
]
CAUSE_SEQUENCE = [
    "Vehicle Collision", "Property Theft", "Water Damage", "Fire Damage", "Slip and Fall",
    "Medical Injury", "Wind Damage", "Vandalism", "Equipment Failure", "Natural Disaster",
    "Workplace Injury", "Product Defect", "Professional Error", "Cyber Attack", "Hail Damage",
]
CAUSE_DESCRIPTIONS = ["vehicle collision damage", "property theft incident", "water damage to property"]
CAUSE_DESCRIPTION_DEFAULT = "reported incident"
CHANGE_STAGES = [
    "Initial Report", "Under Investigation", "Documentation Review", "Adjuster Assigned",
    "Damage Assessment", "Liability Determination",
]
CLAIM_STAGES = [
    "Initial Report", "Under Investigation", "Documentation Review", "Adjuster Assigned",
    "Damage Assessment", "Liability Determination", "Negotiation", "Settlement Review",
    "Payment Processing", "Closed", "Reopened", "Litigation",
]
# claim status by `id % 100`: upper bound (exclusive) -> status
STATUS_BANDS = [
    (45, "Closed"), (55, "Approved"), (65, "Rejected"), (75, "Open"), (90, "Stalled"), (100, "Pending Review"),
]
CLAIM_STATES = ["CA", "TX", "FL", "NY", "PA", "IL", "OH", "GA", "NC", "MI"]
CITIES = [
    "Los Angeles", "San Diego", "San Francisco", "Houston", "Dallas", "Austin", "Miami", "Tampa",
    "Orlando", "New York", "Buffalo", "Albany", "Philadelphia", "Pittsburgh", "Chicago", "Aurora",
    "Columbus", "Cleveland", "Atlanta", "Savannah", "Charlotte", "Raleigh", "Detroit", "Grand Rapids",
]
FIRST_NAMES = [
    "James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "William", "Elizabeth",
    "David", "Barbara", "Richard", "Susan", "Joseph", "Jessica", "Thomas", "Sarah", "Charles", "Karen",
    "Christopher", "Nancy", "Daniel", "Lisa", "Matthew", "Betty", "Anthony", "Margaret", "Mark", "Sandra",
    "Donald", "Ashley", "Steven", "Kimberly", "Paul", "Emily", "Andrew", "Donna", "Joshua", "Michelle",
    "Kenneth", "Dorothy", "Kevin", "Carol", "Brian", "Amanda", "George", "Melissa", "Timothy", "Deborah",
]
LAST_NAMES = [
    "Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis", "Rodriguez", "Martinez",
    "Hernandez", "Lopez", "Gonzalez", "Wilson", "Anderson", "Thomas", "Taylor", "Moore", "Jackson", "Martin",
    "Lee", "Perez", "Thompson", "White", "Harris", "Sanchez", "Clark", "Ramirez", "Lewis", "Robinson",
    "Walker", "Young", "Allen", "King", "Wright", "Scott", "Torres", "Nguyen", "Hill", "Flores",
    "Green", "Adams", "Nelson", "Baker", "Hall", "Rivera", "Campbell", "Mitchell", "Carter", "Roberts",
]
STREETS = ["Oak", "Maple", "Cedar", "Pine", "Elm", "Main", "Park", "Lake", "Hill", "River"]
STREET_SUFFIXES = ["St", "Ave", "Blvd", "Dr"]
EMAIL_FIRST = ["james", "mary", "john", "patricia", "robert", "jennifer", "michael", "linda", "william", "elizabeth"]
EMAIL_FIRST_DEFAULT = "user"
EMAIL_LAST = ["smith", "johnson", "williams"]
EMAIL_LAST_DEFAULT = "doe"
EMAIL_DOMAINS = ["gmail.com", "yahoo.com", "outlook.com", "aol.com", "hotmail.com"]
VENDOR_TYPES = ["Repair Shop", "Medical Provider", "Legal Firm", "Bank"]
VENDOR_NAMES = [
    ["AutoFix", "QuickRepair", "ProBody", "CarCare", "AutoPro", "MasterMech", "SpeedyAuto", "PremiumBody",
     "EliteRepair", "QualityAuto"],
    ["CityMedical", "HealthFirst", "CarePlus", "MedStar", "PrimeCare", "WellnessClinic", "HealthPoint",
     "MedExpress", "CareNetwork", "HealthWorks"],
    ["Smith Associates", "LegalEagle", "JusticeLaw", "DefensePartners", "ClaimsLegal", "LawPro", "LegalShield",
     "RightsFirst", "FairClaim", "LegalAid"],
    ["FirstNational", "CityBank", "TrustFinance", "SecureBank", "UnionCredit", "PeopleBank", "MetroFinance",
     "RegionalTrust", "CommunityBank", "CapitalFirst"],
]
VENDOR_CITIES = ["Los Angeles", "Houston", "Miami", "New York", "Chicago", "Philadelphia", "Atlanta", "Dallas",
                 "Charlotte", "Detroit"]
VENDOR_STATES = ["CA", "TX", "FL", "NY", "IL", "PA", "GA", "TX", "NC", "MI"]
VENDOR_COST_TIERS = ["Low", "Medium", "High"]
COVERAGE_TYPES = ["Comprehensive", "Liability Only", "Collision", "Full Coverage", "Basic"]
COVERAGE_LIMITS = [100000, 250000, 500000, 1000000]
DEDUCTIBLES = [500, 1000, 2500, 5000]
POLICY_TERMS = [6, 12, 24]
AGENCIES = ["Premier Insurance Agency", "Trusted Coverage Group", "AllState Partners", "SecureLife Brokers",
            "National Insurance Services"]
PAYMENT_TYPES = ["Indemnity", "Medical", "Legal", "Expense"]
EXPENSE_CATEGORIES = ["Legal", "Administrative", "Investigation", "Processing"]
TEAMS = ["Auto Claims Team", "Property Claims Team", "Liability Claims Team", "Workers Comp Team",
         "Special Investigations", "Catastrophe Response"]
DEPARTMENT_HEADS = ["John Smith", "Mary Johnson", "Robert Williams", "Patricia Brown", "Michael Davis",
                    "Jennifer Garcia"]
ATTORNEYS = ["James Wilson Esq.", "Sarah Thompson Esq.", "Michael Brown Esq.", "Emily Davis Esq.",
             "Robert Miller Esq.", "Jennifer Garcia Esq.", "David Martinez Esq.", "Lisa Anderson Esq."]
COURTS = ["Superior Court", "District Court", "Circuit Court"]

# ---------------------------------------------------------------------------
# FIXED VALUES — weather: state -> proxy forecast city, with coordinates
# (state, state name, proxy city, latitude, longitude, zip)
# ---------------------------------------------------------------------------
WEATHER_STATE_CITIES = [
    ("CA", "California", "los_angeles", 34.0522, -118.2437, "90001"),
    ("TX", "Texas", "houston", 29.7604, -95.3698, "77001"),
    ("NY", "New York", "new_york", 40.7128, -74.0060, "10001"),
    ("FL", "Florida", "houston", 25.7617, -80.1918, "33101"),
    ("GA", "Georgia", "houston", 33.7490, -84.3880, "30301"),
    ("NC", "North Carolina", "new_york", 35.2271, -80.8431, "28201"),
    ("PA", "Pennsylvania", "new_york", 39.9526, -75.1652, "19101"),
    ("IL", "Illinois", "new_york", 41.8781, -87.6298, "60601"),
    ("OH", "Ohio", "new_york", 39.9612, -82.9988, "43201"),
    ("MI", "Michigan", "new_york", 42.3314, -83.0458, "48201"),
]
# forecast cities of the driver's `events` table, picked by user_id % 3
FORECAST_CITIES = ["los_angeles", "houston", "new_york"]

# ---------------------------------------------------------------------------
# FIXED VALUES — tables the incremental pipeline and the validator expect
# ---------------------------------------------------------------------------
REQUIRED_SOURCE_TABLES = ["CLAIMS", "FINANCIAL_DATA", "LITIGATION", "POLICY", "INSURED", "LINE_OF_BUSINESS",
                          "CATASTROPHE", "CLAIMS_EXPENSE"]


# ---------------------------------------------------------------------------
# DataFrame constructors (tiny, broadcast-safe)
# ---------------------------------------------------------------------------
def line_of_business(spark: SparkSession) -> DataFrame:
    schema = T.StructType([
        T.StructField("LOB_ID", T.IntegerType(), False),
        T.StructField("LOB_NAME", T.StringType()),
        T.StructField("LOB_LEAD", T.StringType()),
        T.StructField("LOB_CATEGORY", T.StringType()),
    ])
    return spark.createDataFrame(LINES_OF_BUSINESS, schema)


def catastrophe(spark: SparkSession) -> DataFrame:
    schema = T.StructType([
        T.StructField("CATASTROPHE_ID", T.IntegerType(), False),
        T.StructField("CATASTROPHE_CODE", T.StringType()),
        T.StructField("EVENT_NAME", T.StringType()),
        T.StructField("EVENT_TYPE", T.StringType()),
        T.StructField("EVENT_DATE", T.DateType()),
        T.StructField("END_DATE", T.DateType()),
        T.StructField("IMPACTED_STATES", T.StringType()),
        T.StructField("ESTIMATED_INDUSTRY_LOSS", T.DecimalType(15, 2)),
    ])
    rows = [r[:7] + (Decimal(r[7]).quantize(Decimal("0.01")),) for r in CATASTROPHES]
    return spark.createDataFrame(rows, schema)


def states(spark: SparkSession) -> DataFrame:
    schema = "STATE_CODE string, STATE_NAME string, REGION string"
    return spark.createDataFrame(STATES, schema)


def loss_causes(spark: SparkSession) -> DataFrame:
    schema = ("LOSS_CAUSE string, LOSS_CATEGORY string, IS_WEATHER_RELATED boolean, "
              "WEATHER_CONDITION_MAPPING string")
    return spark.createDataFrame(LOSS_CAUSES, schema)


def expense_budget(spark: SparkSession) -> DataFrame:
    schema = "SEVERITY string, B_LEGAL int, B_ADJ int, B_INV int, B_ULAE int"
    return spark.createDataFrame(EXPENSE_BUDGET, schema)


def weather_state_cities(spark: SparkSession) -> DataFrame:
    schema = ("CLAIM_STATE string, STATE_NAME string, PROXY_CITY string, LATITUDE double, "
              "LONGITUDE double, ZIP_CODE string")
    return spark.createDataFrame(WEATHER_STATE_CITIES, schema)
