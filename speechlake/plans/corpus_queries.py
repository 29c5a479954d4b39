"""Queries over the corpus operators: inventory, fields, joins, dedup, validation, leakage, splits, statistics."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.functions import records as R
from speechlake.operators import corpus as C
from speechlake.operators import splitting as S
from speechlake.operators.sampling import weighted_draws
from speechlake.plans.registry import RECORDS, SCORED, query, records, scored, table
from speechlake.sources import files, manifests

# ---- scans, sources, sinks


@query("SELECT source || ':' || doc_id AS sample_id, strlen(text)::BIGINT AS size_bytes, 'sha256:' || sha256(text) AS file_hash, strlen(text) > 20000 AS quarantined FROM documents")
def inventory(spark, sf_dir):
    return files.inventory(table(spark, sf_dir, "documents").select(F.concat_ws(":", "source", "doc_id").alias("sample_id"), F.encode("text", "UTF-8").alias("content")), 20_000)


_PAGES = "f AS (SELECT page_id, strlen(coalesce(html, '') || chr(10))::BIGINT AS size_bytes, 'sha256:' || sha256(coalesce(html, '') || chr(10)) AS hash FROM pages)"


def _page_files(spark, sf_dir, max_bytes):
    """The pages as files, one each, named after the page."""
    path = files.new_path(spark, "pages")
    html = F.concat(F.coalesce("html", F.lit("")), F.lit("\n"))
    files.write_files(table(spark, sf_dir, "pages").select(F.concat(F.lit("page_id="), "page_id", F.lit(".txt")).alias("name"), F.encode(html, "UTF-8").alias("content")), path)
    found = files.file_inventory(spark, path, ("txt",), max_bytes)
    return found.withColumn("page_id", F.regexp_extract("path", r"page_id=([0-9]+)\.txt", 1).cast("long"))


@query(f"WITH {_PAGES} SELECT page_id, size_bytes, CASE WHEN size_bytes <= 1500 THEN hash END AS file_hash, CASE WHEN size_bytes > 1500 THEN 'file_too_large' END AS problem FROM f")
def file_inventory(spark, sf_dir):
    return _page_files(spark, sf_dir, 1500).drop("path")


@query(f"WITH {_PAGES} SELECT hash AS file_hash, size_bytes, count(*) AS copies FROM f GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_files(spark, sf_dir):
    return files.duplicate_files(_page_files(spark, sf_dir, 1_000_000)).drop("paths")


@query(f"""WITH {RECORDS}, k AS (
  SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY (speaker IS NOT NULL)::INT + (channel IS NOT NULL)::INT + (generator IS NOT NULL)::INT + 2 DESC, dataset_id, sample_id) AS r FROM rec)
  SELECT dataset_id, count(*) AS found, count_if(r = 1)::BIGINT AS kept, count_if(r > 1)::BIGINT AS dropped FROM k GROUP BY dataset_id""")
def discover(spark, sf_dir):
    kept = F.col("is_kept")
    return C.mark_duplicates(records(spark, sf_dir)).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("found"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


_SIDECAR = "SELECT doc_id || '.flac' AS filename, CASE WHEN doc_id % 11 <> 0 THEN 'spk' || (doc_id % 97) END AS speaker, CASE WHEN doc_id % 3 <> 0 THEN 'A' || lpad((doc_id % 20)::VARCHAR, 2, '0') END AS attack FROM documents"


def _sidecar(spark, sf_dir, sep):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        F.concat(i, F.lit(".flac")).alias("Filename "), F.when(i % 11 != 0, F.concat(F.lit("spk"), i % 97)).otherwise("-").alias("SpeakerID"),
        F.when(i % 3 != 0, F.concat(F.lit("A"), F.lpad(i % 20, 2, "0"))).otherwise("n/a").alias("Attack"),
    )
    path = files.new_path(spark, "sidecar")
    rows.write.csv(path, header=True, sep=sep)
    return files.read_sidecar(spark, [path], {"filename": ["filename", "file"], "speaker": ["speakerid", "speaker"], "attack": ["attack"]}, sep=sep)


@query(_SIDECAR)
def sidecar_csv(spark, sf_dir):
    return _sidecar(spark, sf_dir, ",")


@query(_SIDECAR)
def sidecar_tsv(spark, sf_dir):
    return _sidecar(spark, sf_dir, "\t")


@query(f"WITH {RECORDS} SELECT sample_id, split, label, duration_s FROM rec")
def manifest_roundtrip(spark, sf_dir):
    rows = records(spark, sf_dir).select("sample_id", "split", "label", "duration_s")
    path = files.new_path(spark, "manifest")
    files.write_manifest(rows, path, build_id="b1")
    return files.read_manifest(spark, path, rows.schema)


@query(f"""WITH {RECORDS}, one AS (SELECT *, CASE WHEN duration_s < 2 THEN 'short' END AS removed_reason FROM rec
    QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY doc_id) = 1), named AS (
  SELECT 'all' AS manifest, * FROM one UNION ALL SELECT split, * FROM one UNION ALL SELECT 'test_cross_language', * FROM one WHERE split = 'test' AND language = 'de'
  UNION ALL SELECT 'test_cross_channel', * FROM one WHERE split = 'test' AND channel IN ('ch1', 'ch2'))
  SELECT manifest, sample_id, split, language, channel, file_hash, removed_reason, 'b2' AS build_id, count(*) OVER (PARTITION BY manifest) AS published,
         count(*) FILTER (removed_reason IS NULL) OVER (PARTITION BY manifest) AS active FROM named""")
def manifest_set(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("removed_reason", F.when(F.col("duration_s") < 2, "short"))
    first = r.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"))
    rows = r.join(first, ["file_hash", "doc_id"], "left_semi").select("sample_id", "split", "language", "channel", "file_hash", "removed_reason")
    path = files.new_path(spark, "manifests")
    manifests.write_manifest_set(rows.where("split <> 'dev'"), path, "b1")  # replaced by the next build
    manifests.write_manifest_set(rows, path, "b2", {"language": ["de"], "channel": ["ch1", "ch2"], "split": ["none"]}, overwrite=True)
    parts = []
    for name, n in manifests.manifest_names(spark, path).items():
        counts = (F.lit(n["rows"]).cast("long").alias("published"), F.lit(n["active"]).cast("long").alias("active"))
        parts.append(manifests.read_manifest_set(spark, path, name).select(F.lit(name).alias("manifest"), "*", *counts))
    return reduce(DataFrame.unionByName, parts)


@query("SELECT 'r' || vec_id AS recording_id, 'spk' || label AS speaker_id, CASE WHEN label < 5 THEN 'dev' ELSE 'test' END AS split FROM embeddings")
def recordings_jsonl(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.concat(F.lit("r"), "vec_id").alias("recording_id"), F.concat(F.lit("spk"), "label").alias("speaker_id"), F.when(F.col("label") < 5, "dev").otherwise("test").alias("split"))
    path = files.new_path(spark, "recordings")
    files.write_seeded_jsonl(rows, path, seed=7, order="recording_id")
    return files.read_seeded_jsonl(spark, path, rows.schema)


@query("SELECT event_id, event_type FROM events WHERE event_id % 50 <> 0")
def audit_jsonl(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    path = files.new_path(spark, "audit")
    line = F.when(F.col("event_id") % 50 == 0, '{"event_id": 1, "event_ty').otherwise(F.to_json(F.struct("event_id", "event_type")))
    e.select(line.alias("value")).write.text(path)
    return files.read_jsonl_leniently(spark, path, "event_id bigint, event_type string")


@query(f"WITH {RECORDS} SELECT dataset_id, count(*) AS rejected FROM rec WHERE duration_s < 2 GROUP BY dataset_id")
def rejected_report(spark, sf_dir):
    r = records(spark, sf_dir).where("duration_s < 2").select("sample_id", "dataset_id", F.lit("too_short").alias("code"))
    path = files.new_path(spark, "rejected")
    for part in (0, 1):  # appended build by build
        r.where(F.pmod(F.xxhash64("sample_id"), F.lit(2)) == part).write.mode("append").json(path)
    return spark.read.schema(r.schema).json(path).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rejected"))


# ---- fields of records


@query("SELECT doc_id, CASE WHEN lower(trim(t)) IN ('-', 'n/a', '') THEN 'unknown' ELSE trim(t) END AS cleaned FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' - ' WHEN 1 THEN 'N/A' WHEN 2 THEN '' ELSE ' ' || lang END AS t FROM documents)")
def unknown_tokens(spark, sf_dir):
    i = F.col("doc_id") % 4
    t = F.when(i == 0, " - ").when(i == 1, "N/A").when(i == 2, "").otherwise(F.concat(F.lit(" "), "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", R.known_or_unknown(t).alias("cleaned"))


@query(f"WITH {RECORDS} SELECT sample_id, dataset_id || ':' || speaker AS speaker_id FROM rec")
def namespace_speaker(spark, sf_dir):
    once = R.namespaced(F.col("dataset_id"), F.col("speaker"))
    return records(spark, sf_dir).select("dataset_id", "sample_id", once.alias("s")).select("sample_id", R.namespaced(F.col("dataset_id"), F.col("s")).alias("speaker_id"))


@query(f"""WITH {RECORDS} SELECT sample_id, CASE doc_id % 7 WHEN 0 THEN 'vocoder' WHEN 1 THEN 'neural_waveform' WHEN 2 THEN 'tts' WHEN 3 THEN 'unclassified' WHEN 4 THEN 'neural_waveform' WHEN 5 THEN 'tts' END AS family, (label = 'spoof')::INT AS label_index FROM rec""")
def labels_and_families(spark, sf_dir):
    i = F.col("doc_id") % 7
    attack = F.when(i == 0, " Hi_Fi_GAN").when(i == 1, "A07").when(i == 2, "vits").when(i == 3, "A99").when(i == 4, "a17").when(i == 5, "Tacotron2")
    return records(spark, sf_dir).select("sample_id", R.attack_family(attack).alias("family"), R.label_index(F.upper("label")).alias("label_index"))


@query(f"WITH {RECORDS} SELECT sample_id, coalesce('speaker:' || speaker, 'parent:' || parent_id) AS group_key, coalesce(language IN ('en', 'de'), false) AS pure FROM rec")
def group_keys(spark, sf_dir):
    return records(spark, sf_dir).select("sample_id", R.partition_key(F.col("speaker"), F.col("parent_id")).alias("group_key"), F.coalesce(F.col("language").isin("en", "de"), F.lit(False)).alias("pure"))


@query("""WITH p AS (SELECT page_id, url, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS parts FROM pages)
  SELECT page_id, parts[1] AS language, parts[-1] AS stem, len(parts)::INT AS depth FROM p""")
def path_fields(spark, sf_dir):
    parts = R.path_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.get(parts, F.lit(0)).alias("language"), F.try_element_at(parts, F.lit(-1)).alias("stem"), F.size(parts).alias("depth"))


@query(f"""WITH {RECORDS} SELECT sample_id, label, CASE WHEN label = 'spoof' THEN CASE doc_id % 3 WHEN 0 THEN 'hi_fi_gan' WHEN 1 THEN 'parallel_wavegan' ELSE 'new_one' END ELSE 'unknown' END AS generator,
  split AS source_split, coalesce(language, 'unknown') AS language, CASE WHEN doc_id % 2 = 0 THEN 'LJ' || (doc_id % 50) ELSE 'unknown' END AS speaker, (doc_id % 97)::VARCHAR AS reader, (doc_id // 3)::VARCHAR AS chapter, (doc_id % 97) || '-' || (doc_id // 3) AS parent FROM rec""")
def layout_fields(spark, sf_dir):
    """Each document's file in the folders that corpora use, and the fields read from that path again."""
    i = F.col("doc_id")
    made = F.when(i % 3 == 0, "HiFi-GAN").when(i % 3 == 1, "Parallel.WaveGAN").otherwise("New One")
    name = F.concat(F.when(i % 2 == 0, F.concat(F.lit("LJ"), i % 50, F.lit("-"))).otherwise(""), i, F.lit(".x.wav"))
    folder = F.when(F.col("label") == "spoof", F.concat(F.lit("Gen/"), made)).otherwise("orig")
    path = F.concat_ws("/", "split", folder, "language", (i % 97).cast("string"), F.floor(i / 3).cast("string"), name)
    r = records(spark, sf_dir).select("sample_id", R.path_parts(path).alias("parts"))
    p = F.col("parts")
    read = R.reading(p)
    return r.select(
        "sample_id", R.folder_label(p).alias("label"), R.folder_generator(p).alias("generator"), R.folder_split(p).alias("source_split"), R.folder_language(p).alias("language"),
        R.stem_speaker(p).alias("speaker"), read["speaker"].alias("reader"), read["chapter"].alias("chapter"), read["parent"].alias("parent"),
    )


@query("""WITH a AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'bona_fide' WHEN 1 THEN 'spoof' ELSE 'unknown' END AS a, CASE doc_id % 4 WHEN 0 THEN 'bona_fide' WHEN 1 THEN 'spoof' ELSE 'unknown' END AS b FROM documents)
  SELECT doc_id, CASE WHEN a = b THEN a WHEN a = 'unknown' THEN b WHEN b = 'unknown' THEN a ELSE 'unknown' END AS label FROM a""")
def reconcile_labels(spark, sf_dir):
    i = F.col("doc_id")
    attack = F.when(i % 3 == 0, "-").when(i % 3 == 1, "a07").otherwise("weird")
    folder = F.when(i % 4 == 0, "bona_fide").when(i % 4 == 1, "spoof").otherwise("unknown")
    return table(spark, sf_dir, "documents").select("doc_id", R.reconciled(R.published_label(attack), folder).alias("label"))


@query(f"WITH {RECORDS} SELECT sample_id, CASE doc_id % 3 WHEN 0 THEN 'phone' WHEN 1 THEN 'codec' ELSE 'clean' END AS channel, CASE WHEN doc_id % 2 = 0 THEN dataset_id ELSE generator END AS generator, CASE WHEN doc_id % 2 = 0 AND generator <> dataset_id || 'x' THEN generator END AS conflict FROM rec")
def channel_and_generator(spark, sf_dir):
    i = F.col("doc_id")
    condition = F.when(i % 3 == 0, "alaw").when(i % 3 == 1, "mp3").otherwise("none")
    channel = F.when(condition.isin("alaw", "ulaw", "g722"), "phone").when(condition.isin("mp3", "opus"), "codec").otherwise("clean")
    folder = F.when(i % 2 == 0, F.col("dataset_id"))
    conflict = F.create_map(F.lit("generator_conflict"), F.when(folder.isNotNull() & (F.col("generator") != F.concat(folder, F.lit("x"))), F.col("generator")))
    return records(spark, sf_dir).select("sample_id", channel.alias("channel"), F.coalesce(folder, "generator").alias("generator"), conflict["generator_conflict"].alias("conflict"))


_DATASETS = """ds AS (SELECT source AS dataset_id, CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'research' WHEN 2 THEN 'restricted' ELSE 'unverified' END AS status,
  CAST(substr(source, 4) AS INT) % 5 <> 0 AS enabled, CAST(substr(source, 4) AS INT) % 7 <> 0 AS present FROM (SELECT DISTINCT source FROM documents))"""


def _datasets(spark, sf_dir):
    n = F.substring("source", 4, 9).cast("int")
    status = F.when(n % 4 == 0, "open").when(n % 4 == 1, "research").when(n % 4 == 2, "restricted").otherwise("unverified")
    return table(spark, sf_dir, "documents").select("source").distinct().select(F.col("source").alias("dataset_id"), status.alias("status"), (n % 5 != 0).alias("enabled"), (n % 7 != 0).alias("present"))


@query(f"WITH {RECORDS}, {_DATASETS} SELECT sample_id, status IN ('open', 'research') AS admitted FROM rec JOIN ds USING (dataset_id)")
def licence_admission(spark, sf_dir):
    d = _datasets(spark, sf_dir)
    allowed = F.col("status").isin("open", "research") & (F.col("status") != "restricted")
    return records(spark, sf_dir).join(d, "dataset_id").select("sample_id", allowed.alias("admitted"))


@query(f"""WITH {RECORDS}, {_DATASETS} SELECT coalesce(CASE WHEN ds.dataset_id IS NULL THEN 'unknown_adapter' WHEN NOT enabled THEN 'disabled' WHEN status NOT IN ('open', 'research') THEN 'license' WHEN NOT present THEN 'not_found' END, 'admitted') AS reason, count(*) AS records
  FROM rec LEFT JOIN ds USING (dataset_id) GROUP BY 1""")
def exclusion_reasons(spark, sf_dir):
    d = _datasets(spark, sf_dir).withColumn("_known", F.lit(True))
    reason = R.first_reason(("unknown_adapter", F.col("_known").isNull()), ("disabled", ~F.col("enabled")), ("license", ~F.col("status").isin("open", "research")), ("not_found", ~F.col("present")))
    return records(spark, sf_dir).join(d, "dataset_id", "left").groupBy(F.coalesce(reason, F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("records"))


@query(f"WITH {RECORDS} SELECT sample_id FROM rec WHERE split = 'train' AND duration_s >= 3")
def resolve_rows(spark, sf_dir):
    return records(spark, sf_dir).where("split = 'train' and duration_s >= 3").select("sample_id")


@query(f"""WITH {SCORED}, b AS (SELECT *, CASE WHEN score < 0.5 THEN 'LOW' WHEN score < 0.8 THEN 'MEDIUM' ELSE 'HIGH' END AS band FROM sc)
  SELECT sample_id, band, CASE WHEN duration_s < 1 THEN 'invalid' WHEN band = 'LOW' THEN 'log_only' WHEN band = 'MEDIUM' THEN 'challenge_mfa' ELSE 'escalate_to_analyst' END AS action,
  CASE WHEN duration_s < 3 THEN 'short' WHEN duration_s <= 6 THEN 'medium' ELSE 'long' END AS duration_band FROM b""")
def bands_and_actions(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("band", R.risk_band(F.col("score")))
    return s.select("sample_id", "band", R.advisory_action(F.col("band"), F.col("duration_s"), F.lit("m1")).alias("action"), R.duration_band(F.col("duration_s")).alias("duration_band"))


@query("SELECT event_id, round(20 * log10(greatest(abs((value - 100) / 400), 1e-12)), 6) AS db, round(2595 * log10(1 + value / 700), 6) AS mel, round(700 * (pow(10.0, (2595 * log10(1 + value / 700)) / 2595) - 1), 6) AS hz FROM events")
def unit_conversions(spark, sf_dir):
    v = F.col("value")
    mel = R.hz_to_mel(v)
    return table(spark, sf_dir, "events").select("event_id", F.round(R.dbfs((v - 100) / 400), 6).alias("db"), F.round(mel, 6).alias("mel"), F.round(R.mel_to_hz(mel), 6).alias("hz"))


@query(f"WITH {RECORDS} SELECT sample_id, coalesce(speaker, 'unknown') AS speaker, coalesce(session, 'unknown') AS session, round(duration_s, 1) AS duration_s, (label = 'spoof')::INT AS label_index FROM rec")
def record_shape(spark, sf_dir):
    return records(spark, sf_dir).select("sample_id", R.known_or_unknown(F.col("speaker")).alias("speaker"), R.known_or_unknown(F.col("session")).alias("session"), F.round("duration_s", 1).alias("duration_s"), R.label_index(F.col("label")).alias("label_index"))


@query(f"WITH {RECORDS} SELECT sample_id, ('0x' || substr(sha256('17|' || sample_id || '|2'), 1, 8))::BIGINT AS seed, sha256(file_hash || chr(0) || 'v1') AS cache_key FROM rec")
def seeds_and_cache_keys(spark, sf_dir):
    return records(spark, sf_dir).select("sample_id", R.derived_seed(17, F.col("sample_id"), 2).alias("seed"), R.cache_key(F.col("file_hash"), "v1").alias("cache_key"))


# ---- joins


@query(f"""WITH {RECORDS}, side AS (SELECT doc_id AS k, CASE doc_id % 3 WHEN 0 THEN 'src' || (doc_id % 20) || '/' || doc_id || '.flac' WHEN 1 THEN doc_id || '.flac' ELSE doc_id::VARCHAR END AS key FROM documents WHERE doc_id % 2 = 0)
  SELECT sample_id, CASE WHEN doc_id % 2 = 0 AND (doc_id % 3 <> 0 OR dataset_id = 'src' || (doc_id % 20)) THEN doc_id END AS matched FROM rec""")
def sidecar_join(spark, sf_dir):
    i = F.col("doc_id")
    name = F.concat(i, F.lit(".flac"))
    keys = F.when(i % 3 == 0, F.concat(F.lit("SRC"), i % 20, F.lit("/"), name)).when(i % 3 == 1, name).otherwise(i.cast("string"))
    side = table(spark, sf_dir, "documents").where(i % 2 == 0).select(keys.alias("key"), i.alias("matched"))
    rows = records(spark, sf_dir).select("sample_id", F.concat("dataset_id", F.lit("/"), name).alias("path"))
    return files.sidecar_join(rows, side, "path", "key", ["matched"]).select("sample_id", "matched")


@query(f"WITH {RECORDS} SELECT sample_id, CASE WHEN doc_id % 13 = 0 THEN 'unreadable' ELSE 'readable' END AS state FROM rec")
def inventory_join(spark, sf_dir):
    r = records(spark, sf_dir)
    seen = r.where(F.col("doc_id") % 13 != 0).select("sample_id", F.lit("readable").alias("_s"))
    return r.join(seen, "sample_id", "left").select("sample_id", F.coalesce("_s", F.lit("unreadable")).alias("state"))


@query(f"WITH {RECORDS} SELECT sample_id, file_hash FROM rec WHERE doc_id % 17 <> 0 AND sha256(file_hash || chr(0) || 'v2') NOT IN (SELECT sha256(file_hash || chr(0) || 'v2') FROM rec WHERE doc_id % 3 = 0)")
def incremental_sources(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("key", R.cache_key(F.col("file_hash"), "v2"))
    retired = r.where(F.col("doc_id") % 17 == 0).select("sample_id")
    done = r.where(F.col("doc_id") % 3 == 0).select("key")
    return r.join(retired, "sample_id", "left_anti").join(done, "key", "left_anti").select("sample_id", "file_hash")


@query(f"WITH {RECORDS} SELECT s.sample_id, a.split FROM rec s LEFT JOIN (SELECT sample_id, split FROM rec WHERE doc_id % 19 <> 0) a USING (sample_id) WHERE a.split IS NOT NULL")
def assignment_join(spark, sf_dir):
    r = records(spark, sf_dir)
    some = r.where(F.col("doc_id") % 19 != 0).select("sample_id", "split")
    return C.assigned(r.select("sample_id").join(some, "sample_id", "left_semi"), some)


@query("""WITH f AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS band FROM embeddings)
  SELECT vec_id, k, round(sum(x::DOUBLE * cos(pi() * k * (band - 0.5) / 64)), 5) AS c FROM f, (SELECT unnest(range(4)) AS k) GROUP BY vec_id, k""")
def basis_projection(spark, sf_dir):
    """A cosine transform as an equi-join with a basis of 64 x 4 rows, which is broadcast: its size is fixed."""
    frames = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("band", "x"))
    basis = spark.range(64).select(F.col("id").cast("int").alias("band"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("k"))
    basis = basis.withColumn("w", F.cos(F.pi() * F.col("k") * (F.col("band") + 0.5) / 64))
    return frames.join(F.broadcast(basis), "band").groupBy("vec_id", "k").agg(F.round(F.sum(F.col("x").cast("double") * F.col("w")), 5).alias("c"))


# ---- deduplication and validation


@query(f"""WITH {RECORDS}, k AS (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY (speaker IS NOT NULL)::INT + (channel IS NOT NULL)::INT + (generator IS NOT NULL)::INT DESC, dataset_id, sample_id) AS r,
  count(*) OVER (PARTITION BY file_hash) AS n FROM rec) SELECT sample_id, n AS group_size, r = 1 AS is_kept FROM k""")
def find_duplicates(spark, sf_dir):
    return C.mark_duplicates(records(spark, sf_dir)).select("sample_id", "group_size", "is_kept")


_MEASURED = RECORDS + """, me AS (SELECT *, duration_s * (doc_id % 10) / 10 AS speech_s, doc_id % 23 <> 0 AS usable, sha256(file_hash) AS content_hash FROM rec),
va AS (SELECT *, CASE WHEN speaker IS NULL THEN 'missing_metadata' WHEN file_bytes > 20000 THEN 'file_too_large' WHEN duration_s < 2 THEN 'too_short' WHEN duration_s > 60 THEN 'too_long'
  WHEN NOT usable THEN 'unusable_signal' WHEN speech_s / duration_s < 0.1 THEN 'no_speech' END AS code FROM me)"""


def _validated(spark, sf_dir):
    i = F.col("doc_id")
    m = records(spark, sf_dir).withColumns({"speech_s": F.col("duration_s") * (i % 10) / 10, "usable": i % 23 != 0, "content_hash": F.sha2("file_hash", 256)})
    return C.validate(m)


@query(f"WITH {_MEASURED} SELECT sample_id, code, CASE code WHEN 'too_short' THEN format('{{:.2f}} s, at least 2.00', duration_s) WHEN 'file_too_large' THEN file_bytes || ' bytes, at most 20000' END AS reason FROM va WHERE code IS NULL OR code IN ('too_short', 'file_too_large')")
def validate_measurements(spark, sf_dir):
    return _validated(spark, sf_dir).where("code is null or code in ('too_short', 'file_too_large')").select("sample_id", "code", "reason")


@query(f"""WITH {_MEASURED} SELECT sample_id, code, CASE code WHEN 'missing_metadata' THEN 'a required field is unknown' WHEN 'file_too_large' THEN file_bytes || ' bytes, at most 20000'
  WHEN 'too_short' THEN format('{{:.2f}} s, at least 2.00', duration_s) WHEN 'too_long' THEN format('{{:.2f}} s, at most 60.00', duration_s)
  WHEN 'unusable_signal' THEN 'the signal cannot be used' WHEN 'no_speech' THEN format('{{:.2f}} speech, at least 0.10', speech_s / duration_s) END AS reason FROM va""")
def validate_all_measurements(spark, sf_dir):
    """Every record, with any of the six reasons; validate_measurements shows three outcomes of them."""
    return _validated(spark, sf_dir).select("sample_id", "code", "reason")


@query(f"""WITH {_MEASURED}, w AS (SELECT *, list_filter([CASE WHEN doc_id % 6 = 0 THEN 'clipping' END, CASE WHEN doc_id % 4 = 0 THEN 'low_snr' END], lambda x: x IS NOT NULL) AS warnings FROM va)
  SELECT sample_id, coalesce(code, CASE WHEN len(warnings) > 0 THEN 'quality_warning' END) AS code, CASE WHEN code IS NULL AND len(warnings) > 0 THEN 'quality issues: ' || array_to_string(warnings, ', ') END AS warned FROM w""")
def validate_with_warnings(spark, sf_dir):
    """Every record, where quality issues reject those that pass the other checks."""
    i = F.col("doc_id")
    issues = F.filter(F.array(F.when(i % 6 == 0, "clipping"), F.when(i % 4 == 0, "low_snr")), lambda x: x.isNotNull())
    v = C.validate(_validated(spark, sf_dir).drop("code", "reason").withColumn("warnings", issues), reject_warnings=True)
    return v.select("sample_id", "code", F.when(F.col("code") == "quality_warning", F.col("reason")).alias("warned"))


_DEDUPED = _MEASURED + """, de AS (SELECT *, CASE WHEN code IS NULL AND sample_id > min(sample_id) FILTER (code IS NULL) OVER (PARTITION BY file_hash) THEN 'duplicate' ELSE code END AS final FROM va)"""


@query(f"WITH {_DEDUPED} SELECT sample_id, final AS code FROM de")
def dedup_after_validation(spark, sf_dir):
    return C.dedup_accepted(_validated(spark, sf_dir)).select("sample_id", "code")


@query(f"WITH {_DEDUPED} SELECT dataset_id, coalesce(final, 'accepted') AS outcome, count(*) AS n, round(sum(duration_s), 4) AS seconds FROM de GROUP BY 1, 2")
def validate_sources(spark, sf_dir):
    out = C.dedup_accepted(_validated(spark, sf_dir))
    return out.groupBy("dataset_id", F.coalesce("code", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration_s"), 4).alias("seconds"))


@query(f"WITH {_DEDUPED} SELECT stage, code, count(*) AS n FROM (SELECT 'validation' AS stage, final AS code FROM de WHERE final IS NOT NULL UNION ALL SELECT 'discovery', 'over_size' FROM rec WHERE file_bytes > 30000 UNION ALL SELECT 'segmentation', 'no_window' FROM rec WHERE duration_s < 1) GROUP BY 1, 2")
def rejection_rollup(spark, sf_dir):
    r = records(spark, sf_dir)
    v = C.dedup_accepted(_validated(spark, sf_dir)).where("code is not null").select(F.lit("validation").alias("stage"), "code")
    d = r.where("file_bytes > 30000").select(F.lit("discovery").alias("stage"), F.lit("over_size").alias("code"))
    s = r.where("duration_s < 1").select(F.lit("segmentation").alias("stage"), F.lit("no_window").alias("code"))
    return v.unionByName(d).unionByName(s).groupBy("stage", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RECORDS} SELECT count(file_hash) = 0 AS file_unavailable, count(session) = 0 AS session_unavailable, count(*) - count(DISTINCT sample_id) AS repeated_ids FROM rec")
def scope_preconditions(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.agg((F.count("file_hash") == 0).alias("file_unavailable"), (F.count("session") == 0).alias("session_unavailable"), (F.count(F.lit(1)) - F.countDistinct("sample_id")).alias("repeated_ids"))


@query(f"WITH {RECORDS}, p AS (SELECT file_hash, split, count(*) AS n FROM rec GROUP BY 1, 2), q AS (SELECT sum(n - 1) AS w, count(*) - 1 AS c FROM p GROUP BY file_hash) SELECT sum(w)::BIGINT AS within_split, sum(c)::BIGINT AS cross_split FROM q")
def manifest_duplicates(spark, sf_dir):
    return C.duplicate_counts(records(spark, sf_dir))


@query(f"""WITH {RECORDS}, ax AS (SELECT split, unnest([{{'axis': 'parent_id', 'value': parent_id}}, {{'axis': 'speaker', 'value': speaker}}, {{'axis': 'file_hash', 'value': file_hash}}, {{'axis': 'session', 'value': session}}, {{'axis': 'generator', 'value': generator}},
  {{'axis': 'language', 'value': language}}, {{'axis': 'channel', 'value': channel}}, {{'axis': 'device', 'value': device}}]) AS p FROM rec),
v AS (SELECT p.axis AS axis, p.value AS value, count(DISTINCT split) AS n FROM ax WHERE p.value IS NOT NULL GROUP BY 1, 2),
g AS (SELECT axis, count(*) AS known, count_if(n > 1) AS leaks, list(value ORDER BY value) FILTER (n > 1 AND axis <> 'file_hash') AS ex FROM v GROUP BY axis),
names AS (SELECT unnest(['parent_id', 'speaker', 'file_hash', 'session', 'generator', 'language', 'channel', 'device']) AS axis)
SELECT axis, coalesce(known, 0)::BIGINT AS known_values, coalesce(leaks, 0)::BIGINT AS leaks, known IS NOT NULL AS available, coalesce(array_to_string(ex[1:8], ','), '') AS examples FROM names LEFT JOIN g USING (axis)""")
def leakage_axes(spark, sf_dir):
    return C.check_leakage(records(spark, sf_dir))


@query(f"""WITH {RECORDS}, ax AS (SELECT split, unnest(['speaker', 'channel', 'session', 'device']) AS axis, unnest([speaker, channel, session, device]) AS value FROM rec),
  v AS (SELECT axis, value, count(DISTINCT split) > 1 AS leak FROM ax WHERE value IS NOT NULL GROUP BY 1, 2), g AS (SELECT axis, bool_or(leak) AS leak FROM v GROUP BY 1)
  SELECT axis, CASE WHEN leak THEN 'leak' ELSE 'unavailable' END AS problem FROM (SELECT DISTINCT axis FROM ax) LEFT JOIN g USING (axis) WHERE leak OR leak IS NULL""")
def leakage_gate(spark, sf_dir):
    return C.leakage_failures(records(spark, sf_dir), ["speaker", "channel", "session", "device"])


@query(f"WITH {RECORDS}, p AS (SELECT parent_id, bool_or(split = 'train') AS a, bool_or(split = 'dev') AS b, bool_or(split = 'test') AS t FROM rec GROUP BY 1) SELECT 'train->test' AS boundary, count_if(a AND t)::BIGINT AS shared FROM p UNION ALL SELECT 'dev->test', count_if(b AND t)::BIGINT FROM p")
def evaluation_boundaries(spark, sf_dir):
    return C.boundaries(records(spark, sf_dir))


@query(f"""WITH {RECORDS}, ax AS (SELECT split, unnest(['speaker', 'session', 'language', 'device']) AS axis, unnest([speaker, session, language, device]) AS value FROM rec),
  v AS (SELECT axis, count(DISTINCT split) > 1 AS leak FROM ax WHERE value IS NOT NULL GROUP BY axis, value), g AS (SELECT axis, count_if(leak) AS leaks FROM v GROUP BY 1),
  a AS (SELECT axis, coalesce(leaks, 0) AS leaks, leaks IS NULL AS absent, axis IN ('speaker', 'session') AS needed FROM (SELECT DISTINCT axis FROM ax) LEFT JOIN g USING (axis)),
  p AS (SELECT parent_id, bool_or(split = 'train') AS a, bool_or(split = 'dev') AS b, bool_or(split = 'test') AS t FROM rec GROUP BY 1),
  f AS (SELECT CASE WHEN leaks > 0 AND needed THEN 'failure' ELSE 'warning' END AS kind, axis AS subject, CASE WHEN leaks > 0 THEN leaks || ' values in more than one split' ELSE 'no known values' END AS detail FROM a WHERE leaks > 0 OR (needed AND absent)
    UNION ALL SELECT 'failure', 'train->test', count(*) || ' sources on both sides' FROM p WHERE a AND t HAVING count(*) > 0
    UNION ALL SELECT 'failure', 'dev->test', count(*) || ' sources on both sides' FROM p WHERE b AND t HAVING count(*) > 0
    UNION ALL SELECT 'failure', 'test_sources', count(*) || ' sources, at least 500' FROM p WHERE t HAVING count(*) < 500)
  SELECT * FROM f UNION ALL SELECT 'gate', CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END, count(*) || ' failures' FROM f WHERE kind = 'failure'""")
def gate_report(spark, sf_dir):
    return C.gate_report(records(spark, sf_dir), ["speaker", "session"], ["speaker", "session", "language", "device"], least_test_sources=500)


@query(f"""WITH {RECORDS} SELECT 'duplicate_ids' AS rule, (SELECT count(*) FROM (SELECT sample_id FROM rec GROUP BY 1 HAVING count(*) > 1)) AS rows UNION ALL
  SELECT 'cross_split_content', (SELECT count(*) FROM (SELECT file_hash FROM rec GROUP BY 1 HAVING count(DISTINCT split) > 1)) UNION ALL
  SELECT 'empty', (count(*) = 0)::BIGINT FROM rec UNION ALL SELECT 'stray_split', count_if(split NOT IN ('train', 'dev', 'test'))::BIGINT FROM rec UNION ALL
  SELECT 'all_retired', CASE WHEN count_if(duration_s >= 2) = 0 THEN count(*) ELSE 0 END FROM rec UNION ALL
  SELECT 'mixed_builds', (count(DISTINCT CASE WHEN doc_id % 100 = 0 THEN 'b0' ELSE 'b1' END) > 1)::BIGINT FROM rec""")
def manifest_rules(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("removed_reason", F.when(F.col("duration_s") < 2, "short"))
    return C.manifest_problems(r.withColumn("build_id", F.when(F.col("doc_id") % 100 == 0, "b0").otherwise("b1")))


@query("SELECT (count(*) >= 10) AS enough_rows, count_if(quality = 0)::BIGINT AS spoof, count_if(quality = 1)::BIGINT AS bona_fide, count_if(quality = 0) >= 5 AND count_if(quality = 1) >= 5 AS both_classes FROM labels")
def training_floors(spark, sf_dir):
    spoof, real = F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1)
    return table(spark, sf_dir, "labels").agg((F.count(F.lit(1)) >= 10).alias("enough_rows"), spoof.alias("spoof"), real.alias("bona_fide"), ((spoof >= 5) & (real >= 5)).alias("both_classes"))


# ---- splits


@query("""WITH RECURSIVE k AS (SELECT source || ':' || doc_id AS sample_id, CASE WHEN doc_id % 11 <> 0 THEN 'speaker:spk' || (doc_id % 97) ELSE 'parent:' || (doc_id // 3) END AS a, CASE WHEN doc_id % 7 = 1 THEN 'block:' || (doc_id // 50) END AS b FROM documents),
  n AS (SELECT DISTINCT a AS u, b AS v FROM k WHERE b IS NOT NULL), e AS MATERIALIZED (SELECT u, v FROM n UNION SELECT v, u FROM n),
  r AS (SELECT DISTINCT a AS s, a AS x FROM k UNION SELECT r.s, e.v FROM r JOIN e ON r.x = e.u), m AS (SELECT s, min(x) AS component FROM r GROUP BY s)
  SELECT sample_id, component FROM k JOIN m ON k.a = m.s""")
def split_components(spark, sf_dir):
    i = F.col("doc_id")
    r = records(spark, sf_dir).withColumn("block", F.when(i % 7 == 1, F.floor(i / 50).cast("string")))
    return S.components(r, ["block"])


_GROUPS = RECORDS + """, gr AS (SELECT coalesce('speaker:' || speaker, 'parent:' || parent_id) AS grp, count(*) AS size, bool_or(coalesce(language IN ('es'), false) AND doc_id % 50 = 1) AS pinned, min(label) AS lo, max(label) AS hi FROM rec GROUP BY 1)"""


def _groups(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("grp", R.partition_key(F.col("speaker"), F.col("parent_id")))
    r = r.withColumn("hold", F.when((F.col("language") == "es") & (F.col("doc_id") % 50 == 1), "yes"))
    return S.group_sizes(r, {"hold": ["yes"]}, labels=True)


@query(f"WITH {_GROUPS} SELECT grp, size, pinned FROM gr")
def split_holdouts(spark, sf_dir):
    return _groups(spark, sf_dir).select("grp", "size", "pinned")


_FILLED = _GROUPS + """, n AS (SELECT sum(size) AS n FROM gr), o AS (SELECT *, sha256(grp) AS o FROM gr),
  b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY o, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o WHERE NOT pinned),
  t AS (SELECT *, before < (SELECT round_even(n * 0.7, 0) FROM n) AS tr FROM b),
  d AS (SELECT *, coalesce(sum(size) OVER (ORDER BY o, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bd FROM t WHERE NOT tr),
  assigned AS (SELECT grp, 'train' AS split FROM t WHERE tr UNION ALL SELECT grp, CASE WHEN bd < (SELECT round_even(n * 0.15, 0) FROM n) THEN 'dev' ELSE 'test' END FROM d UNION ALL SELECT grp, 'test' FROM gr WHERE pinned)"""


@query(f"WITH {_FILLED} SELECT grp, split FROM assigned")
def split_capacity(spark, sf_dir):
    g = _groups(spark, sf_dir).withColumn("key", F.sha2("grp", 256))
    return S.capacity_fill(g, "key")


_LEVEL = "greatest(list_max({d}) - {m}, (list_sum({d}) - list_min({d}) - {m}) / 2, (list_sum({d}) - {m}) / 3)"


@query(f"""WITH {_GROUPS}, o AS (SELECT *, sha256(grp) AS o FROM gr WHERE NOT pinned), cl AS (SELECT coalesce('speaker:' || speaker, 'parent:' || parent_id) AS grp, label, count(*) AS n FROM rec GROUP BY 1, 2),
  tot AS (SELECT label, sum(n) AS c FROM cl JOIN o USING (grp) GROUP BY 1), si AS (SELECT *, lo AS label FROM o WHERE lo = hi), ss AS (SELECT label, sum(size) AS m FROM si GROUP BY 1),
  q AS (SELECT label, [c * 0.7::DOUBLE, c * 0.15::DOUBLE, c * (1 - 0.7::DOUBLE - 0.15::DOUBLE)] AS d, coalesce(m, 0) AS m FROM tot LEFT JOIN ss USING (label)), l AS (SELECT *, {_LEVEL.format(d='d', m='m')} AS l FROM q),
  e AS (SELECT label, round(greatest(d[1] - l, 0), 6) AS t, round(greatest(d[1] - l, 0) + greatest(d[2] - l, 0), 6) AS v FROM l),
  b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY label ORDER BY o, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM si JOIN e USING (label)),
  one AS (SELECT grp, label, size, CASE WHEN before < t THEN 'train' WHEN before < v THEN 'dev' ELSE 'test' END AS split FROM b),
  got AS (SELECT label, sum(size) FILTER (split = 'train') AS a, sum(size) FILTER (split = 'dev') AS b, sum(size) FILTER (split = 'test') AS c FROM one GROUP BY 1),
  ow AS (SELECT [sum(greatest(d[1] - coalesce(a, 0), 0)), sum(greatest(d[2] - coalesce(b, 0), 0)), sum(greatest(d[3] - coalesce(c, 0), 0))] AS d, (SELECT coalesce(sum(size), 0) FROM o WHERE lo <> hi) AS m FROM q LEFT JOIN got USING (label)),
  ol AS (SELECT *, {_LEVEL.format(d='d', m='m')} AS l FROM ow), oe AS (SELECT round(greatest(d[1] - l, 0), 6) AS t, round(greatest(d[1] - l, 0) + greatest(d[2] - l, 0), 6) AS v FROM ol),
  w AS (SELECT *, coalesce(sum(size) OVER (ORDER BY o, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o, oe WHERE lo <> hi)
  SELECT grp, split FROM one UNION ALL SELECT grp, CASE WHEN before < t THEN 'train' WHEN before < v THEN 'dev' ELSE 'test' END FROM w UNION ALL SELECT grp, 'test' FROM gr WHERE pinned""")
def split_stratified(spark, sf_dir):
    return S.stratified_fill(_groups(spark, sf_dir).withColumn("key", F.sha2("grp", 256)), "key")


@query("""WITH g AS (SELECT o_custkey AS grp, count(*) AS size, strftime(min(o_orderdate), '%Y%m%d%H%M%S') AS k FROM orders GROUP BY 1), n AS (SELECT sum(size) AS n FROM g),
  b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY k, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g), t AS (SELECT *, before < (SELECT round_even(n * 0.7, 0) FROM n) AS tr FROM b),
  d AS (SELECT *, coalesce(sum(size) OVER (ORDER BY k, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bd FROM t WHERE NOT tr)
  SELECT grp, 'train' AS split FROM t WHERE tr UNION ALL SELECT grp, CASE WHEN bd < (SELECT round_even(n * 0.15, 0) FROM n) THEN 'dev' ELSE 'test' END FROM d""")
def split_temporal(spark, sf_dir):
    g = S.temporal_order(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate").withColumn("pinned", F.lit(False))
    return S.capacity_fill(g.withColumn("sort", F.concat(F.lit(""), "key")), "sort")


@query(f"""WITH {_FILLED}, c AS (SELECT count(DISTINCT grp) AS g, count_if(split = 'train') AS a, count_if(split = 'dev') AS d, count_if(split = 'test') AS t FROM assigned)
  SELECT unnest(['two_groups', 'empty_split', 'train_groups']) AS rule, unnest([g < 2, a = 0 OR d = 0 OR t = 0, a < 2]) AS broken FROM c""")
def split_guards(spark, sf_dir):
    return S.split_problems(S.capacity_fill(_groups(spark, sf_dir).withColumn("key", F.sha2("grp", 256)), "key"))


@query(f"WITH {RECORDS} SELECT dataset_id, label, count_if(split = 'train')::BIGINT AS train, count_if(split = 'dev')::BIGINT AS dev, count_if(split = 'test')::BIGINT AS test FROM rec GROUP BY 1, 2")
def split_report(spark, sf_dir):
    return records(spark, sf_dir).groupBy("dataset_id", "label").pivot("split", ["train", "dev", "test"]).count().na.fill(0)


@query(f"WITH {RECORDS} SELECT sample_id, 'cross_language' AS view FROM rec WHERE split = 'test' AND language IN ('de', 'es') UNION ALL SELECT sample_id, 'cross_channel' FROM rec WHERE split = 'test' AND channel IN ('ch1')")
def evaluation_views(spark, sf_dir):
    return S.evaluation_views(records(spark, sf_dir), {"language": ["de", "es"], "channel": ["ch1"]})


# ---- statistics, lookups


_AXES = ("split", "label", "dataset_id", "language", "channel", "generator", "device", "session")


@query(f"WITH {RECORDS}, p AS (SELECT unnest([{', '.join('{' + chr(39) + 'axis' + chr(39) + ': ' + chr(39) + a + chr(39) + ', ' + chr(39) + 'value' + chr(39) + ': coalesce(' + a + ', ' + chr(39) + 'unknown' + chr(39) + ')}' for a in _AXES)}]) AS p FROM rec) SELECT p.axis AS axis, p.value AS value, count(*) AS rows FROM p GROUP BY 1, 2")
def corpus_tallies(spark, sf_dir):
    return C.tallies(records(spark, sf_dir), _AXES)


@query(f"WITH {RECORDS} SELECT count(*) AS active, count(DISTINCT parent_id) AS sources, count(DISTINCT speaker) AS speakers, count(DISTINCT file_hash) AS contents, round(count_if(label = 'spoof') / count(*), 6) AS spoof_share FROM rec")
def corpus_statistics(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.agg(F.count(F.lit(1)).alias("active"), F.countDistinct("parent_id").alias("sources"), F.countDistinct("speaker").alias("speakers"), F.countDistinct("file_hash").alias("contents"), F.round(F.count_if(F.col("label") == "spoof") / F.count(F.lit(1)), 6).alias("spoof_share"))


@query(f"WITH {RECORDS} SELECT split, count(*) AS n, round(sum(duration_s), 6) AS total, min(duration_s) AS least, max(duration_s) AS most, round(avg(duration_s), 6) AS mean FROM rec GROUP BY split")
def duration_distribution(spark, sf_dir):
    return C.distribution(records(spark, sf_dir), "duration_s", ["split"])


@query(f"WITH {RECORDS} SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM rec), 6) AS prevalence, round((SELECT count(*) FROM rec) / (2 * count(*)), 6) AS weight FROM rec GROUP BY label")
def class_weights(spark, sf_dir):
    r = records(spark, sf_dir)
    per = r.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = r.agg(F.count(F.lit(1)).alias("all"))
    return per.join(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("all"), 6).alias("prevalence"), F.round(F.col("all") / (2 * F.col("n")), 6).alias("weight"))


@query(f"WITH {RECORDS} SELECT sample_id, CASE WHEN doc_id % 29 = 0 THEN 'takedown' END AS removed_reason FROM rec")
def retire_samples(spark, sf_dir):
    r = records(spark, sf_dir)
    gone = r.where(F.col("doc_id") % 29 == 0).select("sample_id", F.lit("takedown").alias("reason"))
    once = C.retire(r.select("sample_id"), gone)
    return C.retire(once, gone.withColumn("reason", F.lit("again")))


@query(f"WITH {RECORDS}, n AS (SELECT sample_id, dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY sample_id) AS n FROM rec) SELECT sample_id, dataset_id FROM n WHERE n <= 7")
def capped_discovery(spark, sf_dir):
    return C.capped(records(spark, sf_dir).select("sample_id", "dataset_id"), "dataset_id", "sample_id", 7)


@query(f"WITH {RECORDS}, s AS (SELECT sample_id, duration_s, count(*) OVER () > 20 AS truncated FROM rec WHERE duration_s < 5) SELECT * FROM s ORDER BY duration_s, sample_id LIMIT 20")
def rejection_sample(spark, sf_dir):
    return C.top_rows(records(spark, sf_dir).where("duration_s < 5").select("sample_id", "duration_s"), ["duration_s", "sample_id"], 20)


@query(f"WITH {RECORDS} SELECT sample_id, split, label FROM rec WHERE sample_id = (SELECT min(sample_id) FROM rec)")
def manifest_lookup(spark, sf_dir):
    r = records(spark, sf_dir)
    wanted = r.agg(F.min("sample_id").alias("sample_id"))
    return r.join(F.broadcast(wanted), "sample_id").select("sample_id", "split", "label")  # wanted is one row


_AUG = "(('0x' || substr(sha256('aug|' || sample_id || '|{0}'), 1, 13))::BIGINT / 4503599627370496)"


@query(f"""WITH {RECORDS}, u AS (SELECT sample_id, {_AUG.format('noise')} AS un, {_AUG.format('codec')} AS uc, {_AUG.format('snr')} AS us, {_AUG.format('pick')} AS up FROM rec WHERE split = 'train')
  SELECT sample_id, un < 0.5 AS noise, CASE WHEN un < 0.5 THEN round(5 + 20 * us, 4) END AS snr_db, CASE WHEN uc < 0.3 THEN ['alaw', 'ulaw'][1 + floor(up * 2)::INT] END AS codec FROM u""")
def augmentation_plan(spark, sf_dir):
    u = lambda name: R.hash_uniform(F.lit("aug"), F.col("sample_id"), F.lit(name))
    noise = u("noise") < 0.5
    codec = F.when(u("codec") < 0.3, F.get(F.array(F.lit("alaw"), F.lit("ulaw")), F.floor(u("pick") * 2).cast("int")))
    return records(spark, sf_dir).where("split = 'train'").select("sample_id", noise.alias("noise"), F.when(noise, F.round(5 + 20 * u("snr"), 4)).alias("snr_db"), codec.alias("codec"))


@query(f"""WITH {RECORDS}, w AS (SELECT sample_id, (SELECT count(*) FROM rec) / (2.0::DOUBLE * count(*) OVER (PARTITION BY label)) AS w, sha256('7|' || sample_id) AS h FROM rec),
  c AS (SELECT sample_id, h, coalesce(sum(w) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, sum(w) OVER () AS total FROM w),
  d AS (SELECT ('0x' || substr(sha256('7|' || i), 1, 13))::BIGINT / 4503599627370496.0 * (SELECT max(total) FROM c) AS u FROM (SELECT unnest(range((SELECT count(*) FROM rec))) AS i)),
  n AS (SELECT sample_id, count(*) AS times FROM d ASOF JOIN c ON d.u >= c.low GROUP BY 1) SELECT sample_id, coalesce(times, 0) AS times FROM w LEFT JOIN n USING (sample_id)""")
def balanced_sampling(spark, sf_dir):
    """As many draws with replacement as there are rows, by class weight; how often each row is drawn."""
    r = records(spark, sf_dir)
    per = r.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = r.agg(F.count(F.lit(1)).alias("all"))
    weights = per.join(F.broadcast(total)).select("label", (F.col("all") / (2.0 * F.col("n"))).alias("w"))
    weighted = r.join(F.broadcast(weights), "label").select("sample_id", "w")  # a row a class
    drawn = weighted_draws(weighted, "sample_id", "w", r.count(), seed="7").groupBy("sample_id").agg(F.count(F.lit(1)).alias("times"))
    return r.select("sample_id").join(drawn, "sample_id", "left").select("sample_id", F.coalesce("times", F.lit(0)).alias("times"))
