"""Plans with words and segments looked up in tables: memories (T9, T10, T15), the scheme and a model's words (T4, T5, T7) and
``analyze`` with all of them (T14), over whole documents in an open vocabulary.

A document, whole, becomes native text; romanized text of dictionary words, of dictionary words and its own ones in
turn, of its own words after one known word, or of a model's word; or stays. Memories and the model's words are
derived from the documents too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import batches as B
from ..functions import text as X
from ..operators.pipeline import analyze
from ..operators.score import BatchModelScorer, DistinctScorer, NeutralScorer
from ..operators.translate import score_translations, segments_of, translate_by_segments
from ..operators.translit import transliterate
from . import sqlfrag as S
from .catalog import register, table
from .views import _entries, docs

_NATIVE, _ROMAN = _entries()
_WORDS_SQL = S.split_ws(S.strip("text"))


def _pick(entries, w):
    return f"[{', '.join(S.q(e) for e in entries)}][1 + length({w}) % {len(entries)}]"


def _map_sql(body):
    return f"array_to_string(list_transform({_WORDS_SQL}, lambda w, i: {body}), ' ')"


#: doc_id modulo 20 -> text; the others stay.
OPEN_SQL = f"""(SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN {_map_sql(_pick(_NATIVE, 'w'))}
  WHEN doc_id % 20 = 2 THEN {_map_sql(_pick(_ROMAN, 'w'))}
  WHEN doc_id % 4 = 2 THEN {_map_sql(f"CASE WHEN i % 2 = 1 THEN {_pick(_ROMAN, 'w')} ELSE w END")}
  WHEN doc_id % 20 = 3 THEN 'kammi ' || text WHEN doc_id % 20 = 7 THEN {_map_sql("'hubli'")} ELSE text END AS text FROM documents) AS open_texts"""


def in_open_words(df):
    k = F.col("doc_id")

    def words(where, entries, every=1):
        return B.by_length(F.when(where, F.col("text")), entries, every)
    native, roman, turns, model = k % 4 == 1, k % 20 == 2, (k % 4 == 2) & (k % 20 != 2), k % 20 == 7
    text = (F.when(native, words(native, _NATIVE)).when(roman, words(roman, _ROMAN)).when(turns, words(turns, _ROMAN, 2))
            .when(k % 20 == 3, F.concat(F.lit("kammi "), F.col("text"))).when(model, words(model, ["hubli"])).otherwise(F.col("text")))
    return df.select("doc_id", text.alias("text"))


def open_texts(spark, sf):
    return in_open_words(docs(spark, sf))


# --------------------------------------------------------------------------- the model's words, the memories
_WORDS_TABLE_SQL = f"""words AS (SELECT DISTINCT src, 'ಪದ' || length(src) AS dst FROM (
  SELECT {_WORDS_SQL}[1] AS src FROM documents WHERE doc_id % 7 = 2 UNION ALL SELECT 'hubli' FROM documents) WHERE src <> '')"""


#: Of native texts: a first segment is known to people, one of even length to a machine.
def _memory_sql():
    from .q_text import _segments_sql
    return f"""msegs AS (SELECT doc_id, {_segments_sql('body')} AS segs
  FROM (SELECT doc_id, {S.strip('text')} AS body FROM {OPEN_SQL} WHERE doc_id % 4 = 1 AND NOT {S.is_blank('text')})),
mboth AS (SELECT segs[1] AS k, 0 AS layer, 'human ' || length(segs[1]) AS t, 'human' AS source FROM msegs WHERE doc_id % 3 = 0
  UNION ALL SELECT s, 1, 'machine ' || length(s), 'machine' FROM (SELECT unnest(segs) AS s FROM msegs) WHERE length(s) % 2 = 0),
memory AS (SELECT k, b.t, b.source FROM (SELECT k, min({{'layer': layer, 't': t, 'source': source}}) AS b FROM mboth GROUP BY k))"""


def model_words(spark, sf):
    first = F.when(F.col("doc_id") % 7 == 2, F.get(X.split_ws(X.py_strip("text")), F.lit(0)))
    d = docs(spark, sf).select(F.explode(F.array(first, F.lit("hubli"))).alias("src")).filter("src <> ''").distinct()
    return d.select("src", F.concat(F.lit("ಪದ"), F.length("src").cast("string")).alias("dst"))


def memories(spark, sf):
    segs = in_open_words(docs(spark, sf).filter("doc_id % 4 = 1")).select("doc_id", segments_of("text").alias("segs"))

    def named(name, s):
        return s.select(F.col("s").alias("source_text"), F.concat(F.lit(name + " "), F.length("s").cast("string")).alias("translated_text"))
    human = segs.filter("doc_id % 3 = 0").select(F.get("segs", F.lit(0)).alias("s")).filter("s is not null")
    machine = X.explode_rows(segs, F.filter("segs", lambda s: F.length(s) % 2 == 0), "s")
    return [("human", named("human", human)), ("machine", named("machine", machine))]


# --------------------------------------------------------------------------- T9 + T10
_NAMES = ["human", "machine"]
_SEGMENTED_SQL = f"""{_memory_sql()},
native AS (SELECT doc_id, text FROM {OPEN_SQL}),
{S.segmented_ctes('native', 'doc_id', 'text', 'memory', _NAMES)}"""


@register("translate_by_segments", f"""
WITH {_SEGMENTED_SQL}
SELECT n.doc_id, CASE WHEN {S.is_blank('text')} THEN text ELSE tr END AS translated, coalesce(g.backend, 'human') AS backend,
  coalesce(g.sources, '') AS sources, coalesce(g.n, 0) AS n_segments FROM native n LEFT JOIN _sg g USING (doc_id)""")
def q_translate_by_segments(spark, sf):
    t = translate_by_segments(open_texts(spark, sf), "text", memories(spark, sf), "r")
    return t.select("doc_id", "r.translated", "r.backend", F.array_join("r.sources", ", ").alias("sources"),
                    F.size("r.segments").cast("long").alias("n_segments"))


@register("translate_memories_only", f"""
WITH {_SEGMENTED_SQL}
SELECT n.doc_id, CASE WHEN {S.is_blank('text')} THEN text WHEN n_fallback > 0 THEN {S.strip('text')} ELSE tr END AS translated,
  CASE WHEN n_fallback > 0 THEN 'human' ELSE coalesce(g.backend, 'human') END AS backend, NOT coalesce(n_fallback > 0, false) AS success,
  CASE WHEN n_fallback > 0 THEN 'Translation failed: segments in no memory: ' || n_fallback END AS error
FROM native n LEFT JOIN _sg g USING (doc_id)""")
def q_translate_memories_only(spark, sf):
    t = translate_by_segments(open_texts(spark, sf), "text", memories(spark, sf), "r", auto_fallback=False)
    return t.select("doc_id", "r.translated", "r.backend", "r.success", "r.error")


# --------------------------------------------------------------------------- T15 with backends
@register("score_translation_memories", f"""
WITH {_SEGMENTED_SQL},
o AS (SELECT n.doc_id, n.text, d.source AS category, coalesce(g.n_fallback > 0, false) AS failed, g.backend AS used,
  CASE WHEN {S.is_blank('n.text')} THEN n.text ELSE tr END AS out FROM native n JOIN documents d USING (doc_id) LEFT JOIN _sg g USING (doc_id)),
w AS (SELECT *, {S.lower_word_set('out')} AS a, {S.lower_word_set('text')} AS e FROM o)
SELECT doc_id, category, CASE WHEN failed THEN 'human' ELSE coalesce(used, 'human') END AS backend,
  CASE WHEN NOT failed THEN round(CASE WHEN len(e) = 0 THEN 0.0 ELSE least(greatest(len(list_intersect(a, e))::DOUBLE / len(e) * 5.0::DOUBLE,
    1.0::DOUBLE), 5.0::DOUBLE) END, 6) END AS score, NOT failed AS success,
  CASE WHEN length(text) > 35 THEN substr(text, 1, 32) || '...' ELSE text END AS display FROM w""")
def q_score_translation_memories(spark, sf):
    t = open_texts(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    s = score_translations(t, "doc_id", "text", "source", native="text", memories=memories(spark, sf), auto_fallback=False)
    return s.withColumn("score", F.round("score", 6))


# --------------------------------------------------------------------------- T4, T5, T7
@register("transliterate_open", f"""
WITH {_WORDS_TABLE_SQL},
{S.spelled_ctes(OPEN_SQL, 'doc_id', 'text', 'words')}
SELECT o.doc_id, CASE WHEN {S.is_blank('text')} THEN text ELSE tl END AS transliterated,
  CASE WHEN {S.is_blank('text')} THEN 'unchanged' ELSE method END AS method FROM {OPEN_SQL.replace('AS open_texts', 'AS o')} LEFT JOIN _sp USING (doc_id)""")
def q_transliterate_open(spark, sf):
    t = transliterate(open_texts(spark, sf), "text", "r", scheme=True, words=model_words(spark, sf))
    return t.select("doc_id", "r.transliterated", "r.method")


# --------------------------------------------------------------------------- T14 with T7 and T10
ANALYZE_OPEN_SQL = S.analyze_sql(OPEN_SQL, "doc_id", "text", words="words", memory="memory", names=_NAMES,
                                 before=f"{_WORDS_TABLE_SQL},\n{_memory_sql()},\n")


@register("analyze_open", ANALYZE_OPEN_SQL)
def q_analyze_open(spark, sf):
    return analyze(open_texts(spark, sf), "text", keep=["doc_id"], scheme=True, words=model_words(spark, sf),
                   memories=memories(spark, sf), details=True)


@register("open_methods", f"""
WITH a AS ({ANALYZE_OPEN_SQL})
SELECT detected_language, transliteration_method, translation_sources, count(*) AS n FROM a GROUP BY ALL""")
def q_open_methods(spark, sf):
    return q_analyze_open(spark, sf).groupBy("detected_language", "transliteration_method", "translation_sources").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- J4 + T11: distinct texts through a network
_LABELS = ["Negative", "Neutral", "Positive"]


def small_network():
    """A fixed layer over three counts of a text's UTF-8 bytes (vowels, blanks, others); a stand-in for a user's model."""
    import numpy as np
    weights = np.array([[0.03125, -0.015625, 0.0], [0.0, 0.0625, -0.03125], [-0.0078125, 0.0, 0.015625]])

    def predict(texts):
        rows = [t.decode() if isinstance(t, bytes) else str(t) for t in texts]
        vowels = np.array([sum(map(t.count, "aeiou")) for t in rows], float)
        blanks = np.array([t.count(" ") for t in rows], float)
        features = np.stack([vowels, blanks, np.array([len(t.encode()) for t in rows], float) - vowels - blanks], 1)
        return (features / 64.0) @ weights
    return predict


_NETWORK_SQL = f"""texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, text, length(regexp_replace(text, '[^aeiou]', '', 'g')) AS v, length(regexp_replace(text, '[^ ]', '', 'g')) AS b,
  octet_length(encode(text)) AS n FROM texts),
g AS (SELECT doc_id, text, v / 64.0::DOUBLE AS x, b / 64.0::DOUBLE AS y, (n - v - b) / 64.0::DOUBLE AS z FROM f),
l AS (SELECT doc_id, text, x * 0.03125 - z * 0.0078125 AS _l0, y * 0.0625 - x * 0.015625 AS _l1, z * 0.015625 - y * 0.03125 AS _l2 FROM g),
{S.softmax_ctes('l')}"""


def texts_or_empty(spark, sf):
    return docs(spark, sf).withColumn("text", F.coalesce("text", F.lit("")))


@register("score_distinct", f"""
WITH {_NETWORK_SQL}
SELECT doc_id, _label AS label, round(_sconf, 6) AS confidence, round(_l0, 6) AS raw_negative, round(_l1, 6) AS raw_neutral,
  round(_l2, 6) AS raw_positive FROM _sm""")
def q_score_distinct(spark, sf):
    scorer = DistinctScorer(BatchModelScorer(small_network, _LABELS))
    s = scorer.score(texts_or_empty(spark, sf), "text")
    raw = F.col("sentiment.raw_scores")
    return s.select("doc_id", "sentiment.label", F.round("sentiment.confidence", 6).alias("confidence"),
                    *[F.round(raw[i], 6).alias(f"raw_{n.lower()}") for i, n in enumerate(_LABELS)])


@register("score_neutral_override", f"""
WITH {_NETWORK_SQL}
SELECT CASE WHEN _sconf < 0.6 THEN 'Neutral' ELSE _label END AS label, count(*) AS n FROM _sm GROUP BY 1""")
def q_score_neutral_override(spark, sf):
    scorer = NeutralScorer(DistinctScorer(BatchModelScorer(small_network, _LABELS)), 0.6)
    s = scorer.score(texts_or_empty(spark, sf), "text")
    return s.groupBy(F.col("sentiment.label").alias("label")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- R1 with lookup tables
#: Micro-batches, each of a file a core.
LANDED_BATCHES = 4


@register("analyze_stream_lookups", f"""
WITH a AS ({ANALYZE_OPEN_SQL}) SELECT * FROM a""")
def q_analyze_stream_lookups(spark, sf):
    """The documents arrive in files, one a core in each micro-batch; every micro-batch is analyzed with the published words and
    memories and all of them together equal the batch."""
    import uuid

    from ..session import ensure_checkpoint_dir, spread
    from ..streaming.lookups import Lookups, analyze_stream_with
    from ..streaming.stream import DOCUMENT_SCHEMA, read_stream
    name = f"lookups-{uuid.uuid4().hex[:10]}"
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    lookups = Lookups(spark, f"{root}/tables")
    lookups.publish("words", model_words(spark, sf))
    lookups.publish_memories(memories(spark, sf))
    arrivals = table(spark, sf, "documents").select(*DOCUMENT_SCHEMA.fieldNames())
    cores = spark.sparkContext.defaultParallelism
    spread(arrivals).repartition(LANDED_BATCHES * cores, "doc_id").write.parquet(f"{root}/landed")
    sdf = in_open_words(read_stream(spark, f"{root}/landed", max_files_per_trigger=cores))
    out = analyze_stream_with(sdf, lookups, "text", "doc_id", name, scheme=True, details=True)
    return spark.read.parquet(f"{out}/rows").drop("batch")
