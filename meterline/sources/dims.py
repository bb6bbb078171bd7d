"""S3 constant dimensions: model prices, store products, status labels.

These are fixed-size tables (a handful of rows), so broadcasting them is safe at any
data scale; the size bound is the literal list below, not the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values (must equal the service's price list): USD per million tokens unless noted.
MARKUP = 1.5
MICROS = 1_000_000
DEFAULT_MODEL = "@cf/meta/llama-3.3-70b-instruct-fp8-fast"
TEXT_MODELS = [
    # model, label, input $/M, output $/M, vision
    ("@cf/meta/llama-3.3-70b-instruct-fp8-fast", "Llama 3.3 70B", 0.293, 2.253, False),
    ("@cf/mistralai/mistral-small-3.1-24b-instruct", "Mistral Small 3.1", 0.351, 0.555, True),
    ("@cf/meta/llama-3.1-8b-instruct-fp8-fast", "Llama 3.1 8B", 0.045, 0.384, False),
]
AUDIO_MODEL = "@cf/openai/whisper-large-v3-turbo"
AUDIO_PER_MINUTE = 0.00051          # USD per minute of audio
IMAGE_MODEL = "gpt-image-2"
IMAGE_TEXT_INPUT = 5.0              # USD per million prompt tokens
IMAGE_OUTPUT = 30.0                 # USD per million image tokens
IMAGE_MAX_OUTPUT_TOKENS = 800
CLASSIFIER_MODEL = "typesafe/jev"
CLASSIFIER_INPUT = 0.042            # USD per million input tokens
CLASSIFIER_OVERHEAD_TOKENS = 2000
CLASSIFIER_ESTIMATE_EXTRA = 300
DEFAULT_MAX_TOKENS = 1024
MAX_TOKENS_CAP = 4096
MAX_BODY_CHARS = 200_000
IMAGE_TOKENS = 4096
MIN_AUDIO_BYTES_PER_MINUTE = 50_000
DEFAULT_AUDIO_SECONDS = 60
MAX_INSTRUCTIONS = 8000
RATE_LIMIT_CODES = (3036, 3040)

# Store products: product id -> credit (micro-dollars).
STORE_PRODUCTS = [
    ("com.example.credits5", 5_000_000),
    ("com.example.credits10", 10_000_000),
    ("com.example.credits25", 25_000_000),
    ("com.example.credits50", 50_000_000),
]
BUNDLE_ID = "com.example.credits"


def text_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(m, lab, float(i), float(o), bool(v)) for m, lab, i, o, v in TEXT_MODELS],
        "model string, label string, price_in double, price_out double, vision boolean")


def store_products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STORE_PRODUCTS, "product_id string, credit_micros long")
