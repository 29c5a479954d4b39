"""Audit records: screening for identifiers, scrubbing, expiry and clip decisions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlake.functions.records import advisory_action, risk_band
from speechlake.operators.metrics import mean_scores

# The terms that a key must not contain between underscores, the endings of keys that only
# measure such a thing, the shapes of identifiers as whole values, and the folders of users.
KEY_TERMS = (
    "audio", "waveform", "transcript", "transcripts", "transcription", "raw_bytes", "raw_samples", "sample_data", "sample_values",
    "pcm_data", "pcm", "payload", "payloads", "blob", "blobs", "recording", "recording_id", "phone", "phones", "phone_number",
    "phone_numbers", "msisdn", "account_number", "account_numbers", "accountnumber", "accountnumbers", "iban", "full_name", "full_names",
    "customer_name", "customer_names", "email", "emails", "email_address", "email_addresses", "ssn", "passport", "passports",
)
METRIC_ENDINGS = ("seconds", "milliseconds", "ms", "hz", "sample_count", "samples_count", "sample_per_second", "samples_per_second", "count", "ratio", "percent", "frames", "db", "dbfs")
VALUE_SHAPES = (r"\+?\(?[0-9][0-9\s().-]{7,}", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}")
USER_PATH = r"[A-Za-z]:\\[^\s\"']+|/(?:home|Users)/[^\s\"']+"
LONGEST = 32

_KEY = "(^|_)(" + "|".join(KEY_TERMS) + ")($|_)"
_METRIC = "_(" + "|".join(METRIC_ENDINGS) + ")$"
_VALUE = "^(" + "|".join(VALUE_SHAPES) + ")$"
#: Shapes to look for anywhere in running text.
TEXT_SHAPES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"}
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def screen(rows: DataFrame, json: str, longest: int = LONGEST) -> DataFrame:
    """Add problem: forbidden_key, identifier_value or long_sequence, the first that holds at any level; null if clean.

    The JSON is brought into canonical form, where a string before a colon is a key and any other is a
    value, so all levels are screened by one pass over its strings. Values are screened as wholes, less white
    space at their ends. A long sequence is an array that begins with more than `longest` numbers. A text
    that is no JSON has the problem not_json; null is clean.
    """
    plain = F.regexp_replace(F.to_json(F.try_parse_json(json)), r"\\.", " ")  # no escapes, so strings end at the next quote
    strings = F.regexp_extract_all(plain, F.lit('"[^"]*":?'), F.lit(0))
    key = F.exists(strings, lambda s: s.endswith('":') & F.lower(F.rtrim(s, F.lit('":'))).rlike(_KEY.replace("(^|_)", '(^"|_)')))
    value = F.exists(strings, lambda s: ~s.endswith('":') & F.trim(F.btrim(s, F.lit('"'))).rlike(_VALUE))
    numbers = F.regexp_replace(plain, '"[^"]*"', "").rlike(rf"\[([-+.0-9eE]+,){{{longest}}}[-+.0-9eE]")
    broken = F.col(json).isNotNull() & plain.isNull()
    return rows.withColumn("problem", F.when(broken, "not_json").when(key, "forbidden_key").when(value, "identifier_value").when(numbers, "long_sequence"))


#: The tokens of JSON: strings, with the colon if they are keys, brackets, commas, and numbers and names.
_TOKEN = r'"(?:[^"\\]|\\.)*+"(?:\s*:)?|[{}\[\],]|[^\s{}\[\],:"]+'
_OPEN = "array<struct<at:int,commas:int,list:boolean,hidden:boolean>>"
_HIDDEN = '"[redacted]"'


def _encoded(value: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def _scrubbed(out: Column, token: Column) -> Column:
    """The state behind one more token: what is written, whether the value that follows is hidden, and the brackets that are open.

    A bracket remembers how long the text was before it, so that closing it can put a summary in place of
    all that was written since.
    """
    written, hide, stack = out["text"], out["hide"], out["open"]
    kind, top = F.left(token, F.lit(1)), F.try_element_at(stack, F.lit(-1))
    string = F.try_variant_get(F.try_parse_json(F.regexp_replace(token, r"\s*:$", "")), "$", "string")
    name = F.lower(string)
    scalar = F.when(hide, _HIDDEN).when(kind != '"', token).when(F.trim(string).rlike(_VALUE), _HIDDEN).otherwise(_encoded(F.regexp_replace(string, USER_PATH, "[redacted]")))
    before = F.left(written, top["at"])
    long = top["list"] & (top["commas"] >= LONGEST)
    summary = F.concat(before, F.lit('"[list len='), (top["commas"] + 1).cast("string"), F.lit(' redacted]"'))
    key, opening, closing, comma = token.endswith(":"), kind.isin("{", "["), kind.isin("}", "]"), kind == ","
    text = (
        F.when(key, F.concat(written, _encoded(string), F.lit(":"))).when(closing & top["hidden"], F.concat(before, F.lit(_HIDDEN))).when(closing & long, summary)
        .when(opening | closing | comma, F.concat(written, token)).otherwise(F.concat(written, scalar))
    )
    bracket = lambda at, commas, list_, hidden: F.array(F.struct(at.alias("at"), commas.alias("commas"), list_.alias("list"), hidden.alias("hidden"))).cast(_OPEN)
    below = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
    counted = F.concat(below, bracket(top["at"], top["commas"] + 1, top["list"], top["hidden"]))
    now = F.when(opening, F.concat(stack, bracket(F.length(written), F.lit(0), kind == "[", hide))).when(closing, below).when(comma, counted).otherwise(stack)
    forbidden = key & name.rlike(_KEY) & ~name.rlike(_METRIC)
    return F.struct(text.alias("text"), F.coalesce(forbidden, F.lit(False)).alias("hide"), now.alias("open"))


def scrub(text: Column) -> Column:
    """JSON with what must not be logged taken out, at every level.

    Values of forbidden keys (unless these end like a metric), identifiers and users' folders are
    redacted, lists of more than LONGEST values are summed up. White space between tokens goes, strings are
    brought into one form. Null stays null; text that is no JSON becomes "[redacted]", as does what Spark's
    parser refuses: a key that comes twice, or brackets a thousand deep. All of it is one fold over the
    tokens of a row, in columns and without recursion; its time grows with the square of a record's length.
    """
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("hide"), F.array().cast(_OPEN).alias("open"))
    out = F.aggregate(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), start, _scrubbed, lambda s: s["text"])
    return F.when(F.try_parse_json(text).isNotNull(), out).when(text.isNotNull(), _HIDDEN)


def session_id(value: Column) -> Column:
    """A UUID in lower case; null for anything else."""
    v = F.lower(F.trim(value))
    return F.when(v.rlike(UUID), v)


def with_expiry(rows: DataFrame, created: str, retention_days: int = 30) -> DataFrame:
    """Add expires_at. Retention must be positive."""
    if retention_days <= 0:
        raise ValueError("retention must be positive")
    return rows.withColumn("expires_at", F.col(created) + F.expr(f"interval {retention_days} days"))


def purge(rows: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, expired): a row expires when its time has come."""
    gone = F.col("expires_at") <= now
    return rows.where(~gone), rows.where(gone)


def decide(windows: DataFrame, clip: str, score: str, seconds: str, model: str, least_speech: float = 1.0) -> DataFrame:
    """(clip, score, band, action, outcome): one advisory decision per clip; abstains without a score or with too little speech."""
    n = windows.groupBy(clip).agg(F.sum(F.when(F.col(score).isNotNull(), F.col(seconds))).alias("speech_s"))
    rows = mean_scores(windows, clip, score).join(n, clip)
    speech = F.coalesce("speech_s", F.lit(0.0))
    outcome = F.when(F.col("windows") == 0, "UNSCORED").when(F.col("score").isNull(), "MODEL_UNAVAILABLE").when(speech < least_speech, "INSUFFICIENT_SPEECH").otherwise("DECIDED")
    decided = outcome == "DECIDED"
    band = F.when(decided, risk_band(F.col("score")))
    return rows.select(clip, F.when(decided, F.col("score")).alias("score"), band.alias("band"), advisory_action(band, speech, F.lit(model), least_speech).alias("action"), outcome.alias("outcome"))
