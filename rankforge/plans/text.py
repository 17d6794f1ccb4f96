"""Queries of text functions and chunkers over ``documents`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import subwords as S
from .common import asked, spread, table, texts, tokens, toks
from .registry import query

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')"
_SENTENCES = r"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '')"


@query("tokenize", f"SELECT doc_id AS chunk_id, {toks('text')} AS tokens FROM documents")
def tokenize(spark, sf):
    return tokens(spark, sf)


@query("tokenize_cased", f"SELECT doc_id AS chunk_id, {toks('text').replace('lower(coalesce', '(coalesce')} AS tokens FROM documents")
def tokenize_cased(spark, sf):
    return texts(spark, sf).select("chunk_id", T.tokenize(F.col("text"), lowercase=False).alias("tokens"))


@query("whitespace_words", f"SELECT doc_id AS chunk_id, len({_WORDS}) AS n_words FROM documents")
def whitespace_words(spark, sf):
    return texts(spark, sf).select("chunk_id", F.size(T.whitespace_words(F.col("text"))).alias("n_words"))


@query("term_positions", f"SELECT item_id AS query_id, term, list(pos ORDER BY pos) AS positions FROM (SELECT item_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT item_id, {toks('text')} AS t FROM benchmark)) GROUP BY ALL")
def term_positions(spark, sf):
    t = asked(spark, sf).select("query_id", F.posexplode(T.tokenize(F.col("text"))).alias("pos", "term"))
    return t.groupBy("query_id", "term").agg(F.sort_array(F.collect_list(F.col("pos").cast("long"))).alias("positions"))  # one query's own


_QP = f"p AS (SELECT item_id AS query_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT item_id, {toks('text')} AS t FROM benchmark))"


@query("bigrams_ordered", f"WITH {_QP} SELECT x.query_id, x.pos, x.term AS a, y.term AS b FROM p x JOIN p y ON x.query_id = y.query_id AND y.pos = x.pos + 1")
def bigrams_ordered(spark, sf):
    t = asked(spark, sf).select("query_id", F.posexplode(T.bigrams_ordered(T.tokenize(F.col("text")))).alias("pos", "g"))
    return t.select("query_id", "pos", "g.a", "g.b")


@query("bigrams_unordered", f"WITH {_QP} SELECT DISTINCT x.query_id, least(x.term, y.term) AS a, greatest(x.term, y.term) AS b FROM p x JOIN p y ON x.query_id = y.query_id AND y.pos > x.pos AND y.pos <= x.pos + 8")
def bigrams_unordered(spark, sf):
    return asked(spark, sf).select("query_id", F.explode(T.bigrams_unordered(T.tokenize(F.col("text")), 8)).alias("g")).select("query_id", "g.a", "g.b")


@query(
    "preprocess_text",
    r"""SELECT doc_id AS chunk_id, md5(trim(regexp_replace(replace(replace(replace(replace(coalesce(text, ''), chr(65279), ''), '–', '-'), '—', '-'), '…', '...'), '\s+', ' ', 'g'))) AS digest FROM documents""",
)
def preprocess_text(spark, sf):
    return texts(spark, sf).select("chunk_id", F.md5(T.preprocess_text(F.col("text")).cast("binary")).alias("digest"))


@query("segment_sentences", rf"""SELECT doc_id AS chunk_id, sentence FROM (SELECT doc_id, unnest({_SENTENCES}) AS sentence FROM documents)
    WHERE length(sentence) BETWEEN 20 AND 500 AND NOT regexp_matches(sentence, '^[0-9]+$') AND len(string_split(sentence, ' ')) >= 3""")
def segment_sentences(spark, sf):
    s = texts(spark, sf).select("chunk_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))
    return s.where(T.is_sentence(F.col("sentence")))


@query("filter_sentence", rf"""SELECT count(*) AS n_all, count(*) FILTER (WHERE length(s) BETWEEN 20 AND 500 AND NOT regexp_matches(s, '^[0-9]+$') AND len(string_split(s, ' ')) >= 3) AS n_kept
    FROM (SELECT unnest({_SENTENCES}) AS s FROM documents)""")
def filter_sentence(spark, sf):
    s = texts(spark, sf).select(F.explode(T.sentences(F.col("text"))).alias("sentence"))
    return s.agg(F.count(F.lit(1)).alias("n_all"), F.count(F.when(T.is_sentence(F.col("sentence")), 1)).alias("n_kept"))


def _window_sql(items: str, size: int, stride: int, last: str) -> str:
    return f"""SELECT chunk_id, s AS position, array_to_string(t[s + 1:s + {size}], ' ') AS text FROM (
        SELECT chunk_id, t, unnest(range(0, {last}, {stride})) AS s FROM (SELECT doc_id AS chunk_id, {items} AS t FROM documents))"""


def _windows(df, items, size, stride, cover_all=True):
    w = df.select("chunk_id", F.explode(T.windows(items, size, stride, cover_all)).alias("w"))
    return w.select("chunk_id", F.col("w.position").alias("position"), F.array_join("w.items", " ").alias("text"))


@query("chunk_token_window", f"SELECT * FROM ({_window_sql(toks('text'), 512, 462, 'len(t)')}) WHERE length(trim(text)) >= 50")
def chunk_token_window(spark, sf):
    """512 tokens, 462 apart; the key is (document, position)."""
    return _windows(texts(spark, sf), T.tokenize(F.col("text")), 512, 462).where(F.length(F.trim("text")) >= 50)


@query("chunk_word_window", _window_sql(_WORDS, 384, 256, "len(t)"))
def chunk_word_window(spark, sf):
    return _windows(texts(spark, sf), T.whitespace_words(F.col("text")), 384, 256)


@query(
    "chunk_model_tokens",
    f"""SELECT chunk_id, position, text, row_number() OVER (PARTITION BY chunk_id ORDER BY position) - 1 AS chunk_index, count(*) OVER (PARTITION BY chunk_id) AS total_chunks,
        (row_number() OVER (PARTITION BY chunk_id ORDER BY position) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY chunk_id) - 1, 1) AS rel_position FROM ({_window_sql(toks('text'), 384, 256, 'len(t) - 128')})""",
    "rel_position",
)
def chunk_model_tokens(spark, sf):
    """384 tokens, 128 shared; a text of at most 128 tokens gives none. Place among its document's chunks."""
    w = texts(spark, sf).select("chunk_id", T.windows(T.tokenize(F.col("text")), 384, 256, cover_all=False).alias("w"))
    e = w.select("chunk_id", F.size("w").alias("total_chunks"), F.posexplode("w").alias("chunk_index", "x"))
    rel = F.col("chunk_index") / F.greatest(F.col("total_chunks") - 1, F.lit(1))
    return e.select("chunk_id", F.col("x.position").alias("position"), F.array_join("x.items", " ").alias("text"), "chunk_index", "total_chunks", rel.alias("rel_position"))


@query("chunk_subword_tokens")
def chunk_subword_tokens(spark, sf):
    """Windows of 384 sub-words, 128 shared, with their places in the raw text; tests hold it against a plain loop."""
    import public_tokenizers

    return S.subword_windows(S.piece_offsets(spread(texts(spark, sf)), str(public_tokenizers.path("byte_bpe_50k.json"))))


@query(
    "chunk_sentences",
    rf"""WITH RECURSIVE s AS (SELECT doc_id, {_SENTENCES} AS parts FROM documents),
    f AS (
        SELECT doc_id, parts, 1 AS i, 0::BIGINT AS pack, len(string_split(parts[1], ' '))::BIGINT AS words FROM s WHERE len(parts) > 0
        UNION ALL
        SELECT doc_id, parts, i + 1, CASE WHEN words + len(string_split(parts[i + 1], ' ')) > 300 THEN pack + 1 ELSE pack END,
               CASE WHEN words + len(string_split(parts[i + 1], ' ')) > 300 THEN len(string_split(parts[i + 1], ' ')) ELSE words + len(string_split(parts[i + 1], ' ')) END
        FROM f WHERE i < len(parts))
    SELECT doc_id AS chunk_id, pack AS position, string_agg(parts[i], '. ' ORDER BY i) AS text FROM f GROUP BY doc_id, pack""",
)
def chunk_sentences(spark, sf):
    """Sentences packed greedily to at most 300 words: a fold over each document's own array."""
    p = texts(spark, sf).select("chunk_id", F.posexplode(T.pack_sentences(T.sentences(F.col("text")), 300)).alias("position", "text"))
    return p


@query("running_pack", rf"""WITH RECURSIVE s AS (SELECT doc_id, {_SENTENCES} AS parts FROM documents),
    f AS (SELECT doc_id, parts, 1 AS i, 0::BIGINT AS pack, len(string_split(parts[1], ' '))::BIGINT AS words FROM s WHERE len(parts) > 0 UNION ALL
        SELECT doc_id, parts, i + 1, CASE WHEN words + len(string_split(parts[i + 1], ' ')) > 100 THEN pack + 1 ELSE pack END,
               CASE WHEN words + len(string_split(parts[i + 1], ' ')) > 100 THEN len(string_split(parts[i + 1], ' ')) ELSE words + len(string_split(parts[i + 1], ' ')) END FROM f WHERE i < len(parts))
    SELECT doc_id AS chunk_id, max(pack) + 1 AS n_packs FROM f GROUP BY doc_id""")
def running_pack(spark, sf):
    p = texts(spark, sf).select("chunk_id", F.size(T.pack_sentences(T.sentences(F.col("text")), 100)).alias("n_packs"))
    return p.where("n_packs > 0")


@query("filter_nonblank_doc", "SELECT doc_id AS chunk_id FROM documents WHERE length(trim(text)) > 10")
def filter_nonblank_doc(spark, sf):
    return texts(spark, sf).where(F.length(F.trim("text")) > 10).select("chunk_id")


@query("filter_min_chunk_chars", "SELECT doc_id AS chunk_id FROM documents WHERE length(trim(text)) >= 50")
def filter_min_chunk_chars(spark, sf):
    return texts(spark, sf).where(F.length(F.trim("text")) >= 50).select("chunk_id")


@query("filter_min_words", f"SELECT doc_id AS chunk_id FROM documents WHERE len({_WORDS}) >= 20")
def filter_min_words(spark, sf):
    return texts(spark, sf).where(F.size(T.whitespace_words(F.col("text"))) >= 20).select("chunk_id")


@query("normalize_doc_name", "SELECT doc_id, string_split(replace(source || '_limpio.txt (Contexto ' || doc_id || ')', '_limpio.txt', '_limpio'), ' (')[1] AS name FROM documents")
def normalize_doc_name(spark, sf):
    named = F.concat("source", F.lit("_limpio.txt (Contexto "), F.col("doc_id").cast("string"), F.lit(")"))
    return table(spark, sf, "documents").select("doc_id", T.normalize_doc_name(named).alias("name"))


@query("text_preview", "SELECT doc_id AS chunk_id, left(text, 100) || '...' AS preview FROM documents")
def text_preview(spark, sf):
    return texts(spark, sf).select("chunk_id", T.text_preview(F.col("text")).alias("preview"))


#: Lexicons of the query features, lower-cased words.
MEDICAL = ["paciente", "medicamento", "administración", "dosis"]
QUESTION = ["qué", "cómo", "cuándo", "dónde", "quién"]
TECHNICAL = ["hipoxemia", "nebulización", "intravenosa", "subcutánea"]
_FLAGS = ", ".join(f"list_has_any(w, {words!r}) AS {name}" for name, words in (("has_medical", MEDICAL), ("has_question", QUESTION), ("has_technical", TECHNICAL)))
_FEATURES = rf"""SELECT query_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w), 0.0) AS mean_length, {_FLAGS} FROM (
    SELECT item_id AS query_id, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''), lambda x: lower(x)) AS w FROM benchmark)"""


def features(spark, sf):
    w = F.transform(T.whitespace_words(F.col("text")), F.lower)
    rows = asked(spark, sf).select("query_id", w.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + F.length(x))
    has = lambda words: F.arrays_overlap("w", F.array(*map(F.lit, words)))
    return rows.select("query_id", F.size("w").alias("n_words"), F.coalesce(F.try_divide(total, F.size("w")), F.lit(0.0)).alias("mean_length"), has(MEDICAL).alias("has_medical"), has(QUESTION).alias("has_question"), has(TECHNICAL).alias("has_technical"))


@query("query_features", _FEATURES, "mean_length")
def query_features(spark, sf):
    return features(spark, sf)


PATTERN_SQL = f"""SELECT query_id, n_words, has_medical, has_question, has_technical, CASE WHEN n_words <= 3 THEN 'short' WHEN n_words <= 6 THEN 'medium' ELSE 'long' END || '_' || CASE WHEN has_medical THEN 'med' ELSE 'no_med' END
    || '_' || CASE WHEN has_question THEN 'q' ELSE 'no_q' END || '_' || CASE WHEN has_technical THEN 'tech' ELSE 'no_tech' END AS pattern, mean_length FROM ({_FEATURES})"""


def patterns(spark, sf):
    """Pattern keys; the features stand beside them, so none has to be read back from a key."""
    f = features(spark, sf)
    word = lambda flag, name: F.when(F.col(flag), name).otherwise("no_" + name)
    length = F.when(F.col("n_words") <= 3, "short").when(F.col("n_words") <= 6, "medium").otherwise("long")
    return f.withColumn("pattern", F.concat_ws("_", length, word("has_medical", "med"), word("has_question", "q"), word("has_technical", "tech")))


@query("pattern_key", f"SELECT query_id, pattern FROM ({PATTERN_SQL})")
def pattern_key(spark, sf):
    return patterns(spark, sf).select("query_id", "pattern")
