"""Fixed values.

These lists, names and constants decide results, so they are stated here
once, in plain text, and imported everywhere else.
"""

# Tokens read as "missing" in tabular text, matched exactly and before any strip.
NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Placeholder of a text field without a value; never enters a vocabulary.
MISSING = "<missing>"
# Placeholder used by landed API records.
NOT_AVAILABLE = "N/A"
# Label of an item without any category.
UNKNOWN_CATEGORY = "Unknown"

# Characters removed at both ends of titles, descriptions and list entries.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Accepted headers per unified field, in priority order.
HEADER_ALIASES = {
    "title": ["title"],
    "year": ["year", "release date", "release year"],
    "genres": ["genre", "genres"],
    "description": ["description", "plot"],
    "director": ["directed by", "director"],
    "rating": ["rating"],
    "writer": ["written by", "writer"],
    "duration": ["duration"],
    "votes": ["no of persons voted", "votes"],
    "cast": ["cast"],
}
REQUIRED_FIELDS = ["description", "title", "genres"]

# Plausible release years.
YEAR_LOW, YEAR_HIGH = "1800", "2100"

# Plain decimal numbers; anything else is missing.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Largest director, writer and cast vocabulary.
VOCABULARY_CAP = 2000

# Statistics used when a column has no values (or no spread).
DEFAULT_STATS = {
    "year_min": 1900.0,
    "year_max": 2025.0,
    "rating_mean": 6.5,
    "rating_std": 1.5,
    "duration_mean": 100.0,
    "duration_std": 40.0,
    "votes_log_mean": 10.0,
    "votes_log_std": 2.0,
}
STD_FLOOR = 1e-6

# Metadata inputs of the fused embedding, in order.
MODALITIES = ["genres", "director", "writer", "year", "rating", "duration", "votes", "cast"]

# Split, batching and training defaults.
SEED = 42
TEST_FRACTION = 0.15
VALIDATION_FRACTION = 0.15
BATCH_SIZE = 64
TEMPERATURE = 0.07
EMBED_DIM = 128
HIDDEN = 256
ID_DIM = 16
LAYER_DROPOUT = 0.2
LEARNING_RATE = 1e-3
WEIGHT_DECAY = 1e-4
MODALITY_DROPOUT = 0.3
EPOCHS = 30
PATIENCE = 5

# Retrieval metrics.
METRIC_CUTOFFS = (1, 5, 10)

# Landed page records.
DESCRIPTION_LIMIT = 500
FILM_SUFFIX = " (film)"
PAGE_URL_PREFIX = "https://en.wikipedia.org/wiki/"
PUBLICATION_DATE, DIRECTED_BY, GENRE = "P577", "P57", "P136"

# Run settings shown side by side.
COMPARED_SETTINGS = [
    "data",
    "text_model",
    "finetune_text",
    "embed_dim",
    "hidden_dim",
    "modality_dropout",
    "jaccard",
    "epochs",
    "seed",
]
