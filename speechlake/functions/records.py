"""Column expressions for the metadata of recordings."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for a missing value, attack families, generators, and folder names of corpora.
NULL_TOKENS = ("-", "--", "n/a", "na", "none", "null", "nan", "", "unknown")
FAMILIES = {
    "vocoder": ("melgan", "melgan2", "parallel_wavegan", "waveglow", "hi_fi_gan", "wavemul"),
    "neural_waveform": tuple(f"a{i:02d}" for i in range(1, 18)),
    "tts": ("tacotron2", "fastspeech", "fastspeech2", "wave_tts", "vits", "ljspeech_vits"),
}
GENERATORS = ("melgan", "melgan2", "full_band", "parallel_wavegan", "waveglow", "hi_fi_gan", "wavemul")
ORIGINAL_FOLDERS = ("orig", "original", "real", "bona")
GENERATED_FOLDERS = ("gen", "generated", "fake", "spoof")
SPLIT_FOLDERS = ("train", "dev", "valid", "validation", "eval", "test")
RATIO = 1e-12


def known(value: Column) -> Column:
    """Null for the tokens that stand for a missing value, else the trimmed value."""
    trimmed = F.trim(value)
    return F.when(F.lower(trimmed).isin(*NULL_TOKENS), None).otherwise(trimmed)


def known_or_unknown(value: Column) -> Column:
    """As known(), with the word "unknown" at the manifest's edge."""
    return F.coalesce(known(value), F.lit("unknown"))


def namespaced(dataset: Column, speaker: Column) -> Column:
    """dataset:speaker, once; null for an unknown speaker or a dataset that is no plain name."""
    s = known(speaker)
    prefix = F.concat(dataset, F.lit(":"))
    valid = dataset.rlike(r"^[a-z0-9][a-z0-9_.-]*$")
    return F.when(valid & s.isNotNull(), F.when(s.startswith(prefix), s).otherwise(F.concat(prefix, s)))


def attack_family(attack: Column) -> Column:
    """The family of an attack or generator id, whatever its case; unclassified if it has none, null for null."""
    found = F.when(attack.isNull(), None)
    for family, names in FAMILIES.items():
        found = found.when(F.lower(F.trim(attack)).isin(*names), family)
    return found.otherwise("unclassified")


def label_index(label: Column) -> Column:
    """0 for bona_fide, 1 for spoof, null for any other label."""
    return F.when(F.lower(F.trim(label)) == "bona_fide", 0).when(F.lower(F.trim(label)) == "spoof", 1)


def partition_key(speaker: Column, parent: Column) -> Column:
    """speaker:<id>, or parent:<id> where the speaker is unknown."""
    return F.coalesce(F.concat(F.lit("speaker:"), known(speaker)), F.concat(F.lit("parent:"), parent))


def published_label(attack: Column) -> Column:
    """No attack: bona_fide; A and two digits: spoof; anything else is not known."""
    a = F.upper(F.trim(attack))
    return F.when(known(attack).isNull(), "bona_fide").when(a.rlike(r"^A\d\d$"), "spoof").otherwise("unknown")


def reconciled(first: Column, second: Column) -> Column:
    """One label of two: the same one, the known one, or unknown where they disagree."""
    return F.when(first == second, first).when(first == "unknown", second).when(second == "unknown", first).otherwise("unknown")


def path_parts(url: Column) -> Column:
    """The parts of a path or of a URL's path, without query and fragment."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*/?", ""), r"[?#].*$", "")
    return F.filter(F.split(path, "/"), lambda x: x != "")



def folders(parts: Column) -> Column:
    """The parts of a path but for the file name, in lower case."""
    return F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lower)


def stem(parts: Column) -> Column:
    """The file name of a path without its last suffix."""
    return F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"(?<=.)\.[^.]*$", "")


def _first(parts: Column, test) -> Column:
    return F.get(F.filter(parts, test), F.lit(0))


def folder_label(parts: Column) -> Column:
    """bona_fide or spoof by the first folder, at any depth, that names originals or generated files, else unknown."""
    found = _first(folders(parts), lambda x: x.isin(*ORIGINAL_FOLDERS, *GENERATED_FOLDERS))
    return F.when(found.isin(*ORIGINAL_FOLDERS), "bona_fide").when(found.isin(*GENERATED_FOLDERS), "spoof").otherwise("unknown")


def generator_name(name: Column) -> Column:
    """One spelling per generator: the known one whose letters and digits agree, else lower case joined by underscores."""
    letters = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")
    same = _first(F.array(*[F.lit(g) for g in GENERATORS]), lambda g: letters(g) == letters(name))
    other = F.regexp_replace(F.lower(F.trim(name)), r"[\s.-]+", "_")
    return F.when(known(name).isNull() | (letters(name) == ""), "unknown").otherwise(F.coalesce(same, other))


def folder_generator(parts: Column) -> Column:
    """The folder below the first one of generated files that has one below it; unknown for originals."""
    inner = folders(parts)
    below = F.transform(inner, lambda x, i: F.struct(x.alias("at"), F.get(inner, i + 1).alias("below")))
    name = _first(below, lambda x: x["at"].isin(*GENERATED_FOLDERS) & x["below"].isNotNull())["below"]
    return F.when((folder_label(parts) == "spoof") & name.isNotNull(), generator_name(name)).otherwise("unknown")


def folder_split(parts: Column) -> Column:
    """The split that the corpus itself published, as provenance only; unknown if there is none."""
    return F.coalesce(_first(folders(parts), lambda x: x.isin(*SPLIT_FOLDERS)), F.lit("unknown"))


def folder_language(parts: Column, locale: bool = False) -> Column:
    """The first folder of two letters (with locale, a region may follow), else unknown."""
    pattern = "^[a-z]{2}([-_][a-z]{2,4})?$" if locale else "^[a-z]{2}$"
    return F.coalesce(_first(folders(parts), lambda x: x.rlike(pattern)), F.lit("unknown"))


def stem_speaker(parts: Column, pattern: str = r"^([A-Za-z]{2}\d+)(?=[-_])") -> Column:
    """The first group of the pattern in the file's stem, else unknown."""
    return F.coalesce(F.nullif(F.regexp_extract(stem(parts), pattern, 1), F.lit("")), F.lit("unknown"))


def reading(parts: Column) -> Column:
    """(speaker, chapter, parent) of <speaker>/<chapter>/<file>: the first two folders of digits; unknown and a null parent without."""
    numbers = F.filter(folders(parts), lambda x: x.rlike(r"^\d+$"))
    speaker, chapter = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    return F.struct(F.coalesce(speaker, F.lit("unknown")).alias("speaker"), F.coalesce(chapter, F.lit("unknown")).alias("chapter"), F.concat(speaker, F.lit("-"), chapter).alias("parent"))


def hash_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone: the first 13 hexadecimal digits of their SHA-256."""
    text = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def derived_seed(base: int, sample_id: Column, epoch: int) -> Column:
    """A seed for a row, whatever the order of rows: 8 hexadecimal digits of the SHA-256 of base, id and epoch."""
    text = F.concat_ws("|", F.lit(str(base)), sample_id, F.lit(str(epoch)))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def cache_key(file_hash: Column, signature: str) -> Column:
    """The SHA-256 of a file's hash and a processing signature, with a NUL between them."""
    return F.sha2(F.concat(file_hash, F.lit("\0"), F.lit(signature)), 256)


def dbfs(amplitude: Column) -> Column:
    """Decibels below full scale."""
    return 20 * F.log10(F.greatest(F.abs(amplitude), F.lit(RATIO)))


def hz_to_mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def mel_to_hz(mel: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel / 2595) - 1)


def duration_band(seconds: Column) -> Column:
    return F.when(seconds < 3, "short").when(seconds <= 6, "medium").when(seconds > 6, "long")


def risk_band(score: Column) -> Column:
    """LOW below 0.5, MEDIUM below 0.8, HIGH up to 1; null outside 0 to 1, for null and for NaN."""
    valid = score.isNotNull() & ~F.isnan(score) & score.between(0, 1)
    return F.when(valid, F.when(score < 0.5, "LOW").when(score < 0.8, "MEDIUM").otherwise("HIGH"))


def advisory_action(band: Column, speech_seconds: Column, model: Column, least_speech: float = 1.0) -> Column:
    """What to advise. No model or no band: none; a band on too little speech is an invalid state."""
    act = F.when(band == "LOW", "log_only").when(band == "MEDIUM", "challenge_mfa").when(band == "HIGH", "escalate_to_analyst")
    return F.when(model.isNull() | band.isNull(), "none").when(speech_seconds < least_speech, "invalid").otherwise(act)


def first_reason(*checks: tuple[str, Column]) -> Column:
    """The name of the first check that holds; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks])


def all_reasons(*checks: tuple[str, Column]) -> Column:
    """The names of the checks that hold, in order, comma-joined."""
    return F.concat_ws(",", *[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks])


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
