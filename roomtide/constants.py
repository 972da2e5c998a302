"""Values the results depend on. They are contract, not tuning."""

# Unit of each sensor type.
UNITS = {
    "co2": "ppm",
    "humidity": "%",
    "temperature": "°C",
    "pir": "binary",
    "luminosity": "lux",
}
UNKNOWN_UNIT = "unknown"

# File-name fragments of each sensor type. The first type with a match wins.
FILE_NAME_ALIASES = {
    "co2": ["co2"],
    "pir": ["pir", "motion"],
    "luminosity": ["light", "luminosity"],
    "temperature": ["temperature", "temp"],
    "humidity": ["humidity", "hum", "rh"],
}

# Message topics.
TOPICS = {
    "co2": "iot.co2",
    "pir": "iot.pir",
    "luminosity": "iot.luminosity",
    "temperature": "iot.temperature",
    "humidity": "iot.humidity",
}
DEFAULT_TOPIC = "iot.sensor"

# Patterns that recover a missing room or sensor type.
ROOM_IN_PATH = r"room=([0-9A-Za-z_-]+)"
SENSOR_IN_TOPIC = r"iot\.([^.]+)"

# Texts that stand for "no value".
BLANK_VALUES = ["", "NaN", "nan"]

# Row and hour quality flags, and the valid share an hour needs.
FLAG_VALID = "OK"
FLAG_MISSING = "MISSING"
HOUR_OK = "OK"
HOUR_WARNING = "WARNING"
HOUR_BAD = "BAD"
HOUR_OK_SHARE = 0.9
HOUR_WARNING_SHARE = 0.7

# Comfort bands (bounds included), the CO2 alarm level (excluded), score weights.
TEMPERATURE_BAND = (20.0, 24.0)
HUMIDITY_BAND = (30.0, 60.0)
CO2_ALARM = 1000.0
TEMPERATURE_WEIGHT = 0.5
CO2_WEIGHT = 0.3
HUMIDITY_WEIGHT = 0.2

# An epoch above the first bound is in microseconds, above the second in milliseconds.
MICROSECONDS_ABOVE = 1e15
MILLISECONDS_ABOVE = 1e12

# Page size of a readings query and the date the room and sensor lists default to.
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
LISTING_DATE = "2013-08-23"

# How often the bronze stream starts a batch.
BRONZE_TRIGGER = "10 seconds"
