"""Short fixed lists, as Python values and as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Pages the destination flow covers.
TRAVEL_DESTINATIONS = (
    "New York City",
    "London",
    "Paris",
    "Tokyo",
    "Sydney",
    "Rome",
    "Bangkok",
    "Dubai",
    "Barcelona",
    "Cancun",
    "Bali",
    "Cape Town",
    "Miami",
    "Cairo",
    "Singapore",
)

# Places the weather flow covers, as (city, country, latitude, longitude).
LOCATIONS = (
    ("New York", "US", 40.7128, -74.0060),
    ("London", "UK", 51.5074, -0.1278),
    ("Paris", "FR", 48.8566, 2.3522),
    ("Tokyo", "JP", 35.6762, 139.6503),
    ("Sydney", "AU", -33.8688, 151.2093),
)
FORECAST_DAYS = 2

# Lists the tiered synthesis draws from.
TRIP_DESTINATIONS = (
    "Paris, France",
    "Tokyo, Japan",
    "New York, USA",
    "London, UK",
    "Rome, Italy",
    "Bali, Indonesia",
    "Barcelona, Spain",
    "Sydney, Australia",
    "Amsterdam, Netherlands",
    "Hong Kong",
    "Dubai, UAE",
    "Bangkok, Thailand",
    "Cancun, Mexico",
    "Rio de Janeiro, Brazil",
    "Cape Town, South Africa",
    "Berlin, Germany",
    "Seoul, South Korea",
    "Marrakech, Morocco",
    "Venice, Italy",
    "Singapore",
    "Phuket, Thailand",
    "Athens, Greece",
    "Vienna, Austria",
    "Kyoto, Japan",
    "Prague, Czech Republic",
    "Lisbon, Portugal",
    "San Francisco, USA",
    "Toronto, Canada",
    "Bora Bora, French Polynesia",
    "Stockholm, Sweden",
)
ACCOMMODATION_TYPES = (
    "Hotel",
    "Hostel",
    "Airbnb",
    "Resort",
    "Villa",
    "Guesthouse",
    "Vacation rental",
    "Apartment",
    "Boutique hotel",
    "Riad",
)
TRANSPORTATION_TYPES = (
    "Flight",
    "Train",
    "Bus",
    "Car rental",
    "Ferry",
    "Subway",
    "Plane",
    "Taxi",
    "Cruise",
    "Private car",
)
NATIONALITIES = (
    "American",
    "British",
    "Japanese",
    "Spanish",
    "German",
    "French",
    "Chinese",
    "Australian",
    "Canadian",
    "Italian",
    "Brazilian",
    "Mexican",
    "Korean",
)

# Own short name lists; person names carry no meaning for any result.
MALE_NAMES = ("James", "Liam", "Hiro", "Mateo", "Lukas", "Hugo", "Wei", "Omar")
FEMALE_NAMES = ("Emma", "Olivia", "Yuki", "Sofia", "Hanna", "Chloe", "Mei", "Leila")
FAMILY_NAMES = ("Smith", "Jones", "Sato", "Garcia", "Weber", "Martin", "Chen", "Rossi", "Silva")


def destinations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in TRAVEL_DESTINATIONS], "destination_name string")


def locations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(LOCATIONS), "city string, country string, latitude double, longitude double"
    )


def trip_categories(spark: SparkSession) -> DataFrame:
    """All category lists in one table ``(category, value)``."""
    listed = {
        "destination": TRIP_DESTINATIONS,
        "accommodation": ACCOMMODATION_TYPES,
        "transportation": TRANSPORTATION_TYPES,
        "nationality": NATIONALITIES,
    }
    rows = [(category, value) for category, values in listed.items() for value in values]
    return spark.createDataFrame(rows, "category string, value string")
