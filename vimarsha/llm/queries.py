"""Registered queries of the operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .common import only, read_table
from .plans import register

_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_W} AS w FROM documents),
l AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
f AS (SELECT l.doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM l LEFT JOIN rep ON rep.doc_id = l.doc_id),
g AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > n_words
    OR 2 * n_dup_lines > n_lines
    OR 10 * len(regexp_extract_all(regexp_replace(t, '([\x20\x09-\x0D])', ' ', 'g') || ' ', '!! ')) > n_words
    OR 2 * len(regexp_extract_all(t, '\p{{Lu}}')) > word_chars
    OR 10 * len(regexp_extract_all(t || chr(10), '(?:\.\.\.|…)[\x20\x09\x0B-\x0D]*\n')) > 3 * n_lines
    OR 10 * len(regexp_extract_all(chr(10) || t, '\n[\x20\x09\x0B-\x0D]*[-*•]')) > 9 * n_lines
    OR 5 * len(regexp_extract_all(t, '[0-9]')) > word_chars
    OR contains(lower(t), 'lorem ipsum')
    OR 10 * len(regexp_extract_all(t, '[{{}}]')) > n_words) AS kept
FROM g"""


@register("op2_quality_rules", OP2_SQL)
def op2_quality_rules(spark, sf_dir):
    from .quality_rules import judge
    docs = only(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept")


OP8_SQL = r"""
WITH l AS (SELECT doc_id, i AS no, trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
           FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
                 FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
k AS (SELECT * FROM l WHERE line <> ''),
d AS (SELECT line, length(line) AS n, min((doc_id, no)) AS first FROM k GROUP BY line),
s AS (SELECT line, n, first, n // 3 AS b, n % 3 AS x FROM d WHERE n >= 32),
seg AS (SELECT line, n, first, i, CASE i WHEN 0 THEN 1 WHEN 1 THEN 1 + b ELSE n - (n + 2) // 3 + 1 END AS p,
          CASE i WHEN 0 THEN b WHEN 1 THEN b + (x = 2)::INT ELSE (n + 2) // 3 END AS w
        FROM s, (SELECT unnest([0, 1, 2]) AS i)),
own AS (SELECT line, n, first, i, substring(line, p, w) AS t FROM seg),
probe AS (SELECT a.line, a.n, a.first, i, m.n AS m, substring(a.line, m.p + o, m.w) AS t
          FROM s a JOIN (SELECT DISTINCT n, i, p, w FROM seg) m ON m.n BETWEEN a.n - 2 AND a.n,
               (SELECT unnest([-2, -1, 0, 1, 2]) AS o) WHERE m.p + o >= 1 AND m.p + o + m.w - 1 <= a.n),
near AS (SELECT DISTINCT CASE WHEN own.first < probe.first THEN probe.line ELSE own.line END AS line
         FROM own JOIN probe ON own.i = probe.i AND own.n = probe.m AND own.t = probe.t AND own.line <> probe.line
         WHERE levenshtein(own.line, probe.line) <= 2),
r AS (SELECT k.doc_id, k.no, near.line IS NOT NULL AS near FROM k JOIN d ON d.line = k.line
      LEFT JOIN near ON near.line = k.line WHERE near.line IS NOT NULL OR d.first <> (k.doc_id, k.no)),
n AS (SELECT doc_id, count(*) AS n_lines FROM k GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (near) AS n_removed_near FROM r GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY no) AS t
      FROM (SELECT doc_id, ls[i] AS raw, i AS no FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
            FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))
      WHERE (doc_id, no) NOT IN (SELECT (doc_id, no) FROM r) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed,
  coalesce(g.n_removed_near, 0)::BIGINT AS n_removed_near, length(coalesce(t.t, ''))::BIGINT AS n_chars_left,
  md5(coalesce(t.t, '')) AS text_md5
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""


@register("op8_line_dedup", OP8_SQL)
def op8_line_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from .line_dedup import dedup_lines
    docs = only(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "n_removed_near",
                                    F.char_length(text).cast("long").alias("n_chars_left"),
                                    F.md5(text.cast("binary")).alias("text_md5"))

OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS to_id FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.to_id),
m AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""


@register("op4_jaccard_join", OP4_SQL)
def op4_jaccard_join(spark, sf_dir):
    from .jaccard_join import jaccard_classes
    return jaccard_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@register("op5_packing")
def op5_packing(spark, sf_dir):
    import public_tokenizers

    from .packing import pack_documents
    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@register("op9_decontamination")
def op9_decontamination(spark, sf_dir):
    from .decontaminate import find_leaks
    docs = read_table(spark, sf_dir, "documents")
    return find_leaks(docs, read_table(spark, sf_dir, "benchmark"))


@register("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def _labelled(spark, sf_dir, label, parts, held_out):
    """Documents of the training folds with a label, as (key, text, label)."""
    from pyspark.sql import functions as F

    from .common import small
    from .nbsvm import fold
    docs = only(read_table(spark, sf_dir, "documents"), "doc_id", "text").filter(~fold("doc_id", parts, held_out))
    labels = only(read_table(spark, sf_dir, "labels"), "doc_id", label).filter(F.col(label).isNotNull() & ~fold("doc_id", parts, held_out))
    return docs.join(small(labels), "doc_id").select(F.col("doc_id").alias("key"), "text", F.col(label).alias("label"))


def _judged(scored, parts, held_out, cut):
    from pyspark.sql import functions as F

    from .nbsvm import fold
    return scored.withColumn("held_out", fold("doc_id", parts, held_out)).withColumn(
        "predicted", F.when(F.col("score") >= cut, 1).otherwise(0))


@register("op3_quality_classifier")
def op3_quality_classifier(spark, sf_dir):
    from .nbsvm import fit, score_documents
    model = fit(_labelled(spark, sf_dir, "quality", 5, 0))
    scored = score_documents(read_table(spark, sf_dir, "documents"), model)
    return _judged(scored, 5, 0, 0.3).select("doc_id", "held_out", "score", "predicted")


@register("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    from .toxicity import fit, score_documents
    model = fit(_labelled(spark, sf_dir, "toxic", 3, 1))
    scored = score_documents(read_table(spark, sf_dir, "documents"), model)
    return _judged(scored, 3, 1, 0.7).select("doc_id", "held_out", "score", "predicted", "n_passages")


@register("op6_html_extraction")
def op6_html_extraction(spark, sf_dir):
    from .html_extract import extract
    return extract(only(read_table(spark, sf_dir, "pages"), "page_id", "url", "html"))


@register("op10_url_filter")
def op10_url_filter(spark, sf_dir):
    from .url_filter import Rule, judge_urls
    rules = [Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"),
             Rule("allow", "com/fr/"), Rule("block", "com/de/")]
    pages = only(read_table(spark, sf_dir, "pages"), "page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@register("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    """The feed of a corpus: load all documents, take out exact copies, revise the word counts to words that are not
    mere signs, and count the rest under a second tokenizer version. One batch comes twice, as after a retry."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from .common import saved, scratch
    from .token_counts import Rollup, count_tokens
    docs = read_table(spark, sf_dir, "documents")
    t = F.coalesce(docs["text"], F.lit(""))
    docs = docs.select("doc_id", "source", "lang", F.xxhash64(t).alias("h"), F.crc32(t.cast("binary")).alias("c"), docs["text"])
    counts = saved(count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")), "token-counts")
    first = counts.groupBy("h", "c").agg(F.min("doc_id").alias("first"))
    marked = saved(counts.join(first, ["h", "c"]).withColumn("copy", F.col("doc_id") != F.col("first")), "token-copies")

    def changes(rows, op, version, n, old="0"):
        return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(op).alias("op"),
                           F.col(n).alias("n_tokens"), F.expr(old).alias("old_tokens"))
    rollup = Rollup(spark, scratch(spark, "rollup"))
    rollup.commit("1-load", changes(marked, "insert", "words", "words"))
    for _ in range(2):
        rollup.commit("2-copies", changes(marked.filter("copy"), "delete", "words", "words"))
    rollup.commit("3-signs", changes(marked.filter("not copy"), "revise", "words", "named", "words"))
    rollup.commit("4-bpe", changes(marked.filter("not copy"), "insert", "byte_bpe_50k", "bpe"))
    return rollup.totals()


@register("op12_spelling_variants")
def op12_spelling_variants(spark, sf_dir):
    from .spelling import count_words, group_variants
    words = count_words(read_table(spark, sf_dir, "documents"), damage=199)
    return group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@register("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    from .conversations import audit_conversations, damaged
    rows = damaged(read_table(spark, sf_dir, "conversations"))
    return audit_conversations(rows).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                            "repaired_sha256")


OP11_SQL = """
WITH x AS (SELECT vec_id, min([greatest(-16777216, least(16777216, floor(1024 * e::DOUBLE)))::BIGINT for e in embedding]) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([e for e in embedding if e IS NULL OR NOT isfinite(e)]) = 0
  GROUP BY vec_id),
s AS (SELECT q.vec_id AS query, c.vec_id, coalesce(list_sum([q.v[i] * c.v[i] for i in range(1, least(len(q.v), len(c.v)) + 1)]), 0)::BIGINT AS score
  FROM x q JOIN x c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


@register("op11_exact_topk", OP11_SQL)
def op11_exact_topk(spark, sf_dir):
    from .common import saved
    from .topk import int_vectors, top_k
    vectors = saved(int_vectors(read_table(spark, sf_dir, "embeddings")), "int-vectors")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))
