"""Names, tokens, patterns and constants that the results depend on."""

# Names that tell a column's role.
TEXT_NAMES = ("text", "feedback", "comment", "comments", "review", "reviews", "description", "summary", "notes", "note", "message", "body", "content", "prompt", "response", "transcript", "detail", "details")
IDENTIFIER_NAMES = ("id", "user id", "user_id", "userid", "customer id", "customer_id", "customerid", "order id", "order_id", "orderid", "product id", "product_id", "productid", "uuid", "guid", "ssn", "key")
DATETIME_NAMES = ("date", "time", "date/time", "date_time", "datetime", "timestamp", "created at", "created_at", "updated at", "updated_at", "order date", "order_date", "delivery date", "delivery_date")

DATETIME_PARTS = ("date", "datetime", "timestamp")
IDENTIFIER_ENDS, IDENTIFIER_STARTS = ("_id", " id"), ("id_", "id ")
REFERENCE_ENDS = ("id", "_code", "_ref", "_number")
SENTIMENT_NAMES, RATING_NAMES = ("sentiment", "tone", "sentiment_label"), ("rating", "stars", "score_rating")
COMPLAINT_PARTS = ("complaint", "feedback", "comment")
TARGET_HINTS = ("target", "label", "status", "class", "outcome", "performance", "category", "total", "price", "cost")

# Patterns of column names for the filling of gaps.
DATE_NAME = r"(?i)(^|_)(date|datetime|timestamp|time)(_|$)"
NUMERIC_NAME = r"(?i)(amount|price|cost|quantity|qty|count|number|num|score|rate|percent|percentage|age|total|balance|weight|height|duration|days|hours|units|revenue|profit|salary|latitude|longitude)$"

# Keys under which a language model's answer holds its records, their numbers and their texts.
RECORD_KEYS = ("records", "items", "data", "values", "texts")
NUMBER_KEYS, TEXT_KEYS = ("id", "record_id", "index"), ("text", "value", "content", "feedback")

# Patterns of column contents.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE = r"^\+?[\d\s().-]{7,}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
HEX_TOKEN = r"^[0-9a-fA-F-]{8,36}$"
DATE_LIKE = r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"

# Words that stand for a missing cell, and what fills it.
NULL_WORDS = ("nan", "none", "null", "nat")
UNKNOWN = "unknown"
DATE_SENTINEL = "2000-01-01"
MISSING_CATEGORY = "__MISSING__"

# Names for the column classifier.
CLASSIFIER_ID_NAMES = ("id", "uuid", "guid", "pk", "identifier", "key", "user_id", "user id", "userid", "customer_id", "customer id", "customerid", "order_id", "order id", "orderid", "product_id", "product id", "productid", "supplier_id", "supplier id", "supplierid", "session_id", "session id", "account_id", "account id")
CLASSIFIER_TEXT_HINTS = ("text", "content", "body", "tweet", "caption", "post", "feedback", "comment", "comments", "review", "reviews", "description", "complaint", "complaints", "remark", "remarks", "reason", "message", "messages", "note", "notes", "summary", "narrative", "sentence", "paragraph", "document")
CLASSIFIER_LABEL_HINTS = ("status", "direction", "category", "subtype", "priority", "type", "class", "stage", "state", "flag", "boolean", "is_active", "enabled", "currency", "country_code", "region_code", "rating", "score_band", "target_direction")
ENCODER_ID_NAMES = ("id", "uuid", "guid", "pk", "primary_key", "record_id")

# Name tokens of date pairs.
START_TOKENS = ("start", "ship", "dispatch", "order", "purchase", "created", "requested")
END_TOKENS = ("delivery", "delivered", "arrival", "received", "end", "completed", "fulfilled")

# Name terms of the business roles.
INVENTORY_TERMS = ("on_hand", "reserved", "available", "reorder", "stock", "inventory")
QUANTITY_TERMS = ("qty", "quantity", "units", "items", "count", "ordered", "shipped", "delivered")
PRICE_TERMS = ("price", "cost", "value", "amount", "total", "subtotal", "tax", "discount", "freight", "rate")
STATUS_TERMS = ("status", "state", "stage", "condition", "performance")

# Phrases of the rating and sentiment checks, between word borders.
STRONG_NEGATIVE = ("failed", "ineffective", "disappointed", "damaged", "overwhelming", "overpowering", "poor", "terrible", "awful", r"irritat\w*", "delayed", "not sealed properly", "not properly sealed", "not effective", "not as expected", "did not work", "didn't work", "did not deliver", "didn't deliver", "not deliver", "not meet", "couldn't", "could not", "too strong", "too oily")
MILD_ISSUE = ("could be better", "could improve", "slightly", "a little", "a bit", "minor", "slight", "difficult to", "hard to", "not easy to")
POSITIVE = ("excellent", "great", "wonderful", "worked very well", "worked well", "satisfied", "happy", "effective", "good results", "pleased")
MORE_POSITIVE = ("love", "loved", "great", "excellent", "amazing", "wonderful", "fantastic", "awesome", "perfect", "best", "good", "happy", "pleased", "helpful", "smooth", "impressed", "superb", "enjoyed", "highly recommend", "fast delivery", "high quality")
MORE_NEGATIVE = ("terrible", "bad", "horrible", "awful", "worst", "waste", "poor", "hate", "disappointed", "disappointing", "slow", "broken", "failed", "rude", "useless", "annoying", "frustrated", "never again", "unhappy", "delayed", "issue", "problem")
POSITIVE_LABELS, NEGATIVE_LABELS = ("positive", "pos", "1", "good"), ("negative", "neg", "0", "bad")

# Weights of the candidate score.
CANDIDATE_WEIGHTS = {"statistical": 0.22, "correlation": 0.16, "ml_utility": 0.18, "privacy": 0.14, "completeness": 0.10, "domain_validity": 0.10, "uniqueness": 0.05, "chronology": 0.05}
