"""Queries of training-pair preparation.

Positives and splits go over conversations (document = conversation, index = turn). Pairs with negatives go over the documents
that have a vector: ten in a row are a document, their place in it is the index. Anchors are the stated query set, every
row whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import whitespace_words
from ..operators import blocks, ranking
from ..operators.quantiles import exact_quantiles
from ..operators.keep import fresh_path, stored
from ..operators.stats import tfidf_smooth, top_unique_terms
from .common import table, vectors
from .corpus import _TFIDF, plain_tokens
from .registry import query

PICKED, POSITIVES, NEGATIVES = 10, 3, 5
#: How chunks are made, as a training set's description tells it.
SETTINGS = {"chunk_size": 384, "overlap": 128, "min_chunk_words": 20}


@query(
    "positives_window_join",
    """SELECT anchor_doc, anchor, positive FROM (SELECT a.conv_id AS anchor_doc, a.turn AS anchor, b.turn AS positive, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY abs(b.turn - a.turn), b.turn) AS r
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND abs(a.turn - b.turn) <= 3) WHERE r <= 5""",
)
def positives_window_join(spark, sf):
    """Turns at most 3 apart: an equi join on (conversation, turn) after spreading each turn over its reach."""
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    reach = c.select("conv_id", F.col("turn").alias("positive"), F.explode(F.array(*[F.col("turn") + i for i in (-3, -2, -1, 1, 2, 3)])).alias("turn"))
    order = Window.partitionBy("conv_id", "turn").orderBy(F.abs(F.col("positive") - F.col("turn")), "positive")
    out = c.join(reach, ["conv_id", "turn"]).withColumn("r", F.row_number().over(order)).where("r <= 5")
    return out.select(F.col("conv_id").alias("anchor_doc"), F.col("turn").alias("anchor"), "positive")


_SPLIT = "SELECT conv_id, CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'val' ELSE 'test' END AS split FROM (SELECT DISTINCT conv_id, (conv_id * 7919) % 100 AS h FROM conversations)"


@query("split_by_doc", _SPLIT)
def split_by_doc(spark, sf):
    """80/10/10 by document, from the document's id alone."""
    h = (F.col("conv_id") * 7919) % 100
    return table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", F.when(h < 80, "train").when(h < 90, "val").otherwise("test").alias("split"))


_CHUNKS = f"""ck AS MATERIALIZED (SELECT vec_id AS id, vec_id // 10 AS doc, vec_id % 10 AS i, embedding::DOUBLE[] AS v, text FROM embeddings JOIN documents ON doc_id = vec_id),
    sim AS MATERIALIZED (SELECT a.id AS anchor, b.id AS negative, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM ck a JOIN ck b ON a.doc <> b.doc WHERE a.id % 50 = 0),
    neg AS MATERIALIZED (SELECT anchor, negative, s AS similarity, CASE WHEN s >= 0.7 THEN 'hard' WHEN s >= 0.4 THEN 'semi-hard' ELSE 'easy' END AS pair_type FROM sim WHERE s <= 0.9)"""


def chunk_table(spark, sf):
    """``id, doc, i, v, text``."""
    v = vectors(spark, sf).select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 10).alias("doc"), (F.col("vec_id") % 10).alias("i"), "v")
    return v.join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")


def _band(s):
    return F.when(s >= 0.7, "hard").when(s >= 0.4, "semi-hard").otherwise("easy")


def _vectors(spark, sf):
    """``vec_id, doc, v``, stored."""
    return stored(chunk_table(spark, sf).select(F.col("id").alias("vec_id"), "doc", "v"), "chunks")


def _apart(q, c):
    """Similarities of a block to nine digits; minus infinity within a document, above 0.9 and where a vector is missing."""
    x, y, s = q.v, c.once("v", lambda c: c.v), np.empty((len(q.ids), len(c.ids)))
    for t in blocks.tiles(len(q.ids)):
        for u in blocks.tiles(len(c.ids), blocks.VECTORS):
            s[t, u] = blocks.nine(blocks.cosine(x[t], y[u]))
    s[~(q.ok[:, None] & c.ok[None, :]) | (q.column("doc")[:, None] == c.column("doc")[None, :]) | ~(s <= 0.9)] = -np.inf
    return s


def _met(v, run, schema, asked=None, by=blocks.meet_wide):
    """``run(q, c, similarities)`` for each block of anchors (``asked``, or every row whose id is divisible by 50) with each block of all."""
    return by(v.where("vec_id % 50 = 0") if asked is None else asked, v, lambda q, c: run(q, c, _apart(q, c)), schema)


def _found(q, c, s, at, to):
    return {"anchor": q.ids[at], "negative": c.ids[to], "similarity": s[at, to]}


_FOUND = "anchor long, negative long, similarity double"


def negatives(spark, sf):
    """``anchor, negative, similarity, pair_type``: chunks of other documents; above 0.9 none."""
    made = _met(_vectors(spark, sf), lambda q, c, s: _found(q, c, s, *np.nonzero(s > -np.inf)), _FOUND, by=blocks.meet)
    return made.withColumn("pair_type", _band(F.col("similarity")))


def nearest_negatives(spark, sf, k):
    """The ``k`` most similar of each anchor, from those of each block."""
    made = _met(_vectors(spark, sf), lambda q, c, s: _found(q, c, s, *blocks.firsts(s, k)), _FOUND)
    return ranking.top_k(made, k, ["anchor"], "similarity", ["negative"], digits=9).withColumn("pair_type", _band(F.col("similarity")))


@query("negatives_cross_doc", f"WITH {_CHUNKS} SELECT * FROM neg", "similarity")
def negatives_cross_doc(spark, sf):
    return negatives(spark, sf)


@query("pair_type_counts", f"WITH {_CHUNKS} SELECT pair_type, count(*) AS n FROM neg GROUP BY pair_type")
def pair_type_counts(spark, sf):
    """Counted inside the blocks."""

    def run(q, c, s):
        hard, some = (s >= 0.7).sum(), ((s >= 0.4) & (s < 0.7)).sum()
        return {"pair_type": ["hard", "semi-hard", "easy"], "n": [hard, some, (s > -np.inf).sum() - hard - some]}

    return _met(_vectors(spark, sf), run, "pair_type string, n long").groupBy("pair_type").agg(F.sum("n").alias("n")).where("n > 0")


def diverse(found, terms, most=PICKED, batch=64):
    """``anchor, negative, similarity, pair_type, place``: in order of similarity, each that shares fewer than two terms with those picked before.

    A fold over each anchor's best ``batch`` candidates. Anchors that are not full by then go on after the last one seen, with the terms
    used so far; what clashes with these can't be picked any more and is left out, so each pass picks at least one, and there
    are at most ``most`` passes that find any.
    """
    found = stored(found.join(terms, found["negative"] == terms["id"], "left").select("anchor", "negative", "similarity", "pair_type", F.coalesce("terms", F.array().cast("array<string>")).alias("terms")), "candidates")
    after = F.col("_s").isNull() | (F.col("similarity") < F.col("_s")) | ((F.col("similarity") == F.col("_s")) & (F.col("negative") > F.col("_n")))
    rest = lambda open_: found.join(open_, F.col("anchor") == F.col("_of")).where(after & (F.size(F.array_intersect("terms", "_used")) < 2))
    best = lambda open_: ranking.top_k(rest(open_), batch, ["anchor"], "similarity", ["negative"], digits=9)
    return walked(found.select("anchor").distinct(), dict(found.dtypes)["negative"], best, most, batch)


def walked(anchors, kind, best, most, batch):
    """The passes of ``diverse``: ``best(open)`` gives the next ``batch`` candidates of each open anchor, with its state."""
    picks = F.array().cast(f"array<struct<negative:{kind},similarity:double,pair_type:string>>")
    done, open_ = None, anchors.select(F.col("anchor").alias("_of"), picks.alias("_picked"), F.array().cast("array<string>").alias("_used"), F.lit(None).cast("double").alias("_s"), F.lit(None).cast(kind).alias("_n"))

    def take(acc, x):
        ok = (F.size(acc["picked"]) < most) & (F.size(F.array_intersect(x["terms"], acc["used"])) < 2)
        one = F.array(F.struct(x["negative"].alias("negative"), x["similarity"].alias("similarity"), x["pair_type"].alias("pair_type")))
        return F.struct(F.when(ok, F.concat(acc["picked"], one)).otherwise(acc["picked"]).alias("picked"), F.when(ok, F.array_union(acc["used"], x["terms"])).otherwise(acc["used"]).alias("used"))

    while True:
        each = F.struct("rank", "negative", "similarity", "pair_type", "terms")
        lists = best(open_).groupBy("anchor").agg(F.sort_array(F.collect_list(each)).alias("xs"), F.first("_picked").alias("_picked"), F.first("_used").alias("_used"))  # at most ``batch``
        folded = F.aggregate("xs", F.struct(F.col("_picked").alias("picked"), F.col("_used").alias("used")), take)
        last = F.element_at("xs", -1)
        made = stored(lists.select(F.col("anchor").alias("_of"), folded.alias("f"), F.size("xs").alias("_seen"), last["similarity"].alias("_s"), last["negative"].alias("_n"), F.size("_picked").alias("_before")), "diverse")
        new = made.select(F.col("_of").alias("anchor"), F.posexplode("f.picked").alias("place", "p"), "_before").where("place >= _before")
        new = new.select("anchor", "p.negative", "p.similarity", "p.pair_type", F.col("place").cast("long").alias("place"))
        done = new if done is None else done.unionByName(new)
        open_ = made.where((F.size("f.picked") < most) & (F.col("_seen") >= batch)).select("_of", F.col("f.picked").alias("_picked"), F.col("f.used").alias("_used"), "_s", "_n")
        if open_.isEmpty():
            return done


def _codes(c):
    """A number for each row's terms: the same for the same two or more, else its own."""
    known = {}
    return np.array([known.setdefault(tuple(sorted(t)), len(known)) if len(t) > 1 else -i - 1 for i, t in enumerate(c.table.column("terms").to_pylist())], dtype=np.int64)


def _numbered(c):
    """The numbers of the terms, and a row of them for each row; one number beyond fills up."""
    own, known = [set(t) for t in c.table.column("terms").to_pylist()], {}
    own = [[known.setdefault(x, len(known)) for x in t] for t in own]
    made = np.full((len(own), max(map(len, own), default=0)), len(known))
    for row, t in enumerate(own):
        made[row, : len(t)] = t
    return known, made


def _one_of_each(s, codes):
    """Of candidates with the same two terms or more, the first in order alone: when it has been taken or left out, none of the others can be taken."""
    order = np.argsort(codes, kind="stable")
    _, start, n = np.unique(codes[order], return_index=True, return_counts=True)
    if len(start) == len(codes):
        return s
    x = s[:, order]
    first = x == np.repeat(np.maximum.reduceat(x, start, axis=1), n, axis=1)
    place = np.where(first, np.arange(len(order)), len(order))
    keep = np.zeros((len(s), len(order) + 1), bool)
    np.put_along_axis(keep, np.minimum.reduceat(place, start, axis=1), True, axis=1)
    out = np.full(s.shape, -np.inf)
    out[:, order] = np.where(keep[:, :-1], x, -np.inf)
    return out


def diverse_negatives(spark, sf, most=PICKED, batch=64):
    """``diverse`` over all negatives, of which each block hands on what may come next."""
    terms = stored(unique_terms(spark, sf), "terms")
    return diverse_from(_vectors(spark, sf), terms, most, batch)


def diverse_from(v, terms, most=PICKED, batch=64):
    none = F.array().cast("array<string>")
    v = stored(v.join(terms.withColumnRenamed("id", "vec_id"), "vec_id", "left").withColumn("terms", F.coalesce("terms", none)), "termed")

    def run(q, c, s):
        known, own = c.once("numbered", _numbered)
        state = zip(*(q.table.column(n).to_pylist() for n in ("_used", "_s", "_n")))
        for row, (used, least, last) in enumerate(state):
            if least is not None:
                s[row, ~((s[row] < least) | ((s[row] == least) & (c.ids > last)))] = -np.inf
                taken = np.zeros(len(known) + 1, np.int64)
                taken[[known[t] for t in used if t in known]] = 1
                s[row, taken[own].sum(1) > 1] = -np.inf
        return _found(q, c, s, *blocks.firsts(_one_of_each(s, c.once("codes", _codes)), batch))

    def best(open_):
        asked = v.drop("terms").join(open_.select(F.col("_of").alias("vec_id"), "_used", "_s", "_n"), "vec_id")
        top = ranking.top_k(_met(v, run, _FOUND, asked), batch, ["anchor"], "similarity", ["negative"], digits=9).withColumn("pair_type", _band(F.col("similarity")))
        top = top.join(terms.withColumnRenamed("id", "negative"), "negative", "left").withColumn("terms", F.coalesce("terms", none))
        return top.join(open_, F.col("anchor") == F.col("_of"))

    return walked(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("anchor")), "bigint", best, most, batch)


def unique_terms(spark, sf):
    top = top_unique_terms(tfidf_smooth(plain_tokens(spark, sf)))
    return top.groupBy(F.col("chunk_id").alias("id")).agg(F.collect_set("term").alias("terms"))  # five each


_UNIQUE = "ut AS MATERIALIZED (SELECT chunk_id AS id, list(term) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY round(weight, 6) DESC, term) AS r FROM tfidf) WHERE r <= 5 GROUP BY chunk_id)"
_DIVERSE = f"""{_CHUNKS}, {_TFIDF}, {_UNIQUE},
    cand AS MATERIALIZED (SELECT anchor, negative, similarity, pair_type, coalesce(terms, []::VARCHAR[]) AS terms, row_number() OVER (PARTITION BY anchor ORDER BY similarity DESC, negative) AS r FROM neg LEFT JOIN ut ON ut.id = neg.negative),
    walk AS (SELECT DISTINCT anchor, 0::BIGINT AS r, []::BIGINT[] AS picked, []::VARCHAR[] AS used FROM cand UNION ALL
        SELECT w.anchor, c.r, CASE WHEN len(list_intersect(c.terms, used)) < 2 THEN list_append(picked, c.negative) ELSE picked END, CASE WHEN len(list_intersect(c.terms, used)) < 2 THEN list_concat(used, c.terms) ELSE used END
        FROM walk w JOIN cand c ON c.anchor = w.anchor AND c.r = w.r + 1 WHERE len(picked) < {PICKED}),
    picks AS (SELECT anchor, unnest(picked) AS negative, generate_subscripts(picked, 1) - 1 AS place FROM (SELECT anchor, arg_max(picked, r) AS picked FROM walk GROUP BY anchor)),
    dv AS MATERIALIZED (SELECT anchor, negative, similarity, pair_type, place FROM picks JOIN cand USING (anchor, negative))"""


@query("negatives_diverse", f"WITH RECURSIVE {_DIVERSE} SELECT * FROM dv", "similarity")
def negatives_diverse(spark, sf):
    return diverse_negatives(spark, sf)


def positives(c, most):
    """``anchor, positive``: of the anchor's document, at most three places away, the first ones."""
    a = c.where("id % 50 = 0").select(F.col("id").alias("anchor"), "doc", F.col("i").alias("_i"))
    near = a.join(c.select("doc", "i", F.col("id").alias("positive")), "doc").where("anchor <> positive AND abs(i - _i) <= 3")
    return ranking.top_k(near, most, ["anchor"], "i", ["positive"], descending=False).select("anchor", "positive")


_POSITIVES = "pp AS (SELECT anchor, positive, r FROM (SELECT a.id AS anchor, b.id AS positive, row_number() OVER (PARTITION BY a.id ORDER BY b.i, b.id) AS r FROM ck a JOIN ck b ON a.doc = b.doc AND a.id <> b.id AND abs(a.i - b.i) <= 3 WHERE a.id % 50 = 0))"
_GENERATED = f"{_DIVERSE}, {_POSITIVES}, tp AS MATERIALIZED (SELECT anchor, positive, negative, similarity AS difficulty, pair_type FROM pp JOIN dv USING (anchor) WHERE r <= {POSITIVES} AND place < {NEGATIVES})"


def generated(spark, sf):
    few = diverse_negatives(spark, sf).where(F.col("place") < NEGATIVES)
    return positives(chunk_table(spark, sf), POSITIVES).join(few, "anchor").select("anchor", "positive", "negative", F.col("similarity").alias("difficulty"), "pair_type")


@query("pairs_generate", f"WITH RECURSIVE {_GENERATED} SELECT * FROM tp", "difficulty")
def pairs_generate(spark, sf):
    """At most three positives by five diverse negatives for each anchor."""
    return generated(spark, sf)


#: Shares of a balanced training set, and its largest size.
RATIOS, MOST_PAIRS = {"hard": 0.5, "semi-hard": 0.3, "easy": 0.2}, 200_000


def balanced(pairs):
    """At most each type's share of the total, chosen by a hash of the pair, so that reruns agree."""
    pairs = stored(pairs, "pairs")
    quota = pairs.agg(F.least(F.lit(MOST_PAIRS), F.count(F.lit(1))).alias("total"))
    ratio = F.create_map(*[F.lit(x) for kv in RATIOS.items() for x in kv])[F.col("pair_type")]
    order = F.md5(F.concat_ws("-", "anchor", "positive", "negative"))
    ranked = ranking.top_k(pairs.withColumn("_h", order).withColumn("_one", F.lit(0)), MOST_PAIRS, ["pair_type"], "_one", ["_h"])
    return ranked.crossJoin(F.broadcast(quota)).where(F.col("rank") <= F.floor(F.col("total") * ratio)).select(*pairs.columns)


@query("pairs_balance", f"WITH RECURSIVE {_GENERATED} SELECT anchor, positive, negative, difficulty, pair_type FROM (SELECT *, row_number() OVER (PARTITION BY pair_type ORDER BY md5(anchor || '-' || positive || '-' || negative)) AS r, least(200000, count(*) OVER ()) AS total FROM tp) WHERE r <= floor(total * CASE pair_type WHEN 'hard' THEN 0.5 WHEN 'semi-hard' THEN 0.3 ELSE 0.2 END)", "difficulty")
def pairs_balance(spark, sf):
    return balanced(generated(spark, sf))


_BLOCKED = f"{_CHUNKS}, {_POSITIVES}, bp AS MATERIALIZED (SELECT anchor, positive, negative, similarity AS difficulty, pair_type FROM pp JOIN (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY similarity DESC, negative) AS nr FROM neg) USING (anchor) WHERE r <= 2 AND nr <= 3)"


def blocked(spark, sf):
    best = nearest_negatives(spark, sf, 3)
    return positives(chunk_table(spark, sf), 2).join(best, "anchor").select("anchor", "positive", "negative", F.col("similarity").alias("difficulty"), "pair_type")


@query("pairs_blocked", f"WITH {_BLOCKED} SELECT * FROM bp", "difficulty")
def pairs_blocked(spark, sf):
    """Two positives by the three most similar negatives; blocks of vectors meet in bounded tasks, with no cap on pairs."""
    return blocked(spark, sf)


_TEXTS = "ht AS (SELECT bp.*, a.text AS ta, p.text AS tp, n.text AS tn, a.doc FROM bp JOIN ck a ON a.id = anchor JOIN ck p ON p.id = positive JOIN ck n ON n.id = negative)"


def hydrated(spark, sf):
    """Pairs with their three texts ``ta, tp, tn`` and the anchor's ``doc``; unknown ids go."""
    c = chunk_table(spark, sf)
    text = lambda of, name: c.select(F.col("id").alias(of), F.col("text").alias(name))
    return blocked(spark, sf).join(text("anchor", "ta"), "anchor").join(text("positive", "tp"), "positive").join(text("negative", "tn"), "negative").join(c.select(F.col("id").alias("anchor"), "doc"), "anchor")


@query("pair_hydrate", f"WITH {_BLOCKED}, {_TEXTS} SELECT anchor, positive, negative, md5(ta) AS anchor_digest, md5(tp) AS positive_digest, md5(tn) AS negative_digest FROM ht")
def pair_hydrate(spark, sf):
    return hydrated(spark, sf).select("anchor", "positive", "negative", F.md5("ta").alias("anchor_digest"), F.md5("tp").alias("positive_digest"), F.md5("tn").alias("negative_digest"))


_VALID = r"ta <> tp AND ta <> tn AND tp <> tn AND " + " AND ".join(rf"len(list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> '')) >= 10" for t in ("ta", "tp", "tn"))


def valid(pairs):
    long = [F.size(whitespace_words(F.col(t))) >= 10 for t in ("ta", "tp", "tn")]
    return pairs.where("ta <> tp AND ta <> tn AND tp <> tn").where(long[0] & long[1] & long[2])


@query("valid_pair_filter", f"WITH {_BLOCKED}, {_TEXTS} SELECT anchor, positive, negative FROM ht WHERE {_VALID}")
def valid_pair_filter(spark, sf):
    """Three different texts of at least ten words each."""
    return valid(hydrated(spark, sf)).select("anchor", "positive", "negative")


def _split(doc):
    h = (doc * 7919) % 100
    return F.when(h < 80, "train").when(h < 90, "val").otherwise("test")


_SPLIT_CASE = "CASE WHEN (doc * 7919) % 100 < 80 THEN 'train' WHEN (doc * 7919) % 100 < 90 THEN 'val' ELSE 'test' END"


def training_set(spark, sf):
    """The folder of a training set: valid pairs with their split (of the anchor's document), every chunk, and the description."""
    from ..sources import training

    ids = F.struct(F.col("anchor").alias("anchor"), F.col("positive").alias("positive"), F.col("negative").alias("negative")).alias("ids")
    pairs = valid(hydrated(spark, sf)).select(_split(F.col("doc")).alias("split"), F.col("ta").alias("anchor"), F.col("tp").alias("positive"), F.col("tn").alias("negative"), "difficulty", F.col("pair_type").alias("type"), ids)
    c, total = chunk_table(spark, sf), F.count(F.lit(1)).over(Window.partitionBy("doc"))  # ten chunks a document
    terms = unique_terms(spark, sf).select(F.col("id").alias("_of"), F.array_sort("terms").alias("unique_terms"))
    named = c.select(F.col("id").alias("chunk_id"), F.col("doc").alias("doc_id"), "text", (F.col("i") / total).alias("position"), F.size(whitespace_words(F.col("text"))).alias("length"), F.col("i").alias("chunk_index"), total.alias("total_chunks"))
    chunks = named.join(terms, F.col("chunk_id") == F.col("_of"), "left").drop("_of")
    return training.write_training_set(pairs, chunks, fresh_path(spark, "training"), SETTINGS)


@query("sink_training_jsonl", f"WITH {_BLOCKED}, {_TEXTS} SELECT {_SPLIT_CASE} AS split, anchor AS anchor_id, positive AS positive_id, negative AS negative_id, md5(ta) AS anchor, md5(tp) AS positive, md5(tn) AS negative, difficulty, pair_type AS type FROM ht WHERE {_VALID}", "difficulty")
def sink_training_jsonl(spark, sf):
    """Valid pairs written as JSON lines, a folder for each split, and read back."""
    from ..sources import training

    back = training.read_pairs(spark, training_set(spark, sf))
    return back.select("split", F.col("ids.anchor").alias("anchor_id"), F.col("ids.positive").alias("positive_id"), F.col("ids.negative").alias("negative_id"), F.md5("anchor").alias("anchor"), F.md5("positive").alias("positive"), F.md5("negative").alias("negative"), "difficulty", "type")


@query("sink_training_chunks", rf"""WITH {_CHUNKS}, {_TFIDF}, {_UNIQUE} SELECT ck.id AS chunk_id, doc AS doc_id, md5(text) AS text, i::DOUBLE / count(*) OVER (PARTITION BY doc) AS position, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS length,
    i AS chunk_index, count(*) OVER (PARTITION BY doc) AS total_chunks, array_to_string(list_sort(terms), ' ') AS unique_terms FROM ck LEFT JOIN ut ON ut.id = ck.id""", "position")
def sink_training_chunks(spark, sf):
    """The chunks beside the pairs, written and read back."""
    from ..sources import training

    return training.read_training_chunks(spark, training_set(spark, sf)).withColumns({"text": F.md5("text"), "unique_terms": F.when(F.col("unique_terms").isNotNull(), F.concat_ws(" ", "unique_terms"))})


@query("sink_training_metadata", f"""WITH {_BLOCKED}, {_TEXTS}, w AS (SELECT {_SPLIT_CASE} AS split, pair_type FROM ht WHERE {_VALID})
    SELECT (SELECT count(*) FROM ck) AS total_chunks, (SELECT count(DISTINCT doc) FROM ck) AS total_documents, 384 AS chunk_size, 128 AS overlap, 20 AS min_chunk_words, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test,
    count(*) FILTER (split = 'train' AND pair_type = 'hard') AS hard, count(*) FILTER (split = 'train' AND pair_type = 'semi-hard') AS semi_hard, count(*) FILTER (split = 'train' AND pair_type = 'easy') AS easy FROM w""")
def sink_training_metadata(spark, sf):
    """The description: sizes, settings, pairs of each split, types of the training pairs; 0 where there are none."""
    from ..sources import training

    m = training.read_metadata(spark, training_set(spark, sf))
    part = lambda of, key: F.coalesce(F.col(of)[key], F.lit(0)).alias(key.replace("-", "_"))
    return m.select("total_chunks", "total_documents", *SETTINGS, *[part("splits", k) for k in ("train", "val", "test")], *[part("pair_types", k) for k in RATIOS])


@query("prep_report", rf"""WITH {_BLOCKED}, l AS (SELECT len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM documents)
    SELECT (SELECT count(*) FROM l) AS n_docs, (SELECT sum(n)::BIGINT FROM l) AS total_words, (SELECT avg(n) FROM l) AS mean_words, (SELECT stddev_pop(n) FROM l) AS std_words, (SELECT min(n) FROM l) AS min_words, (SELECT max(n) FROM l) AS max_words, (SELECT quantile_cont(n::DOUBLE, 0.5) FROM l) AS median_words,
    count(*) AS n_pairs, avg(difficulty) AS mean_difficulty, stddev_pop(difficulty) AS std_difficulty, min(difficulty) AS min_difficulty, max(difficulty) AS max_difficulty, quantile_cont(difficulty, 0.5) AS median_difficulty,
    (SELECT count(*) FROM (SELECT anchor FROM bp UNION SELECT positive FROM bp UNION SELECT negative FROM bp))::DOUBLE / (SELECT count(*) FROM ck) AS coverage FROM bp""", "mean_words std_words median_words mean_difficulty std_difficulty min_difficulty max_difficulty median_difficulty coverage")
def prep_report(spark, sf):
    """Lengths of the texts, difficulty of the pairs, and the share of chunks that some pair uses."""
    five = lambda c, name: [F.avg(c).alias(f"mean_{name}"), F.stddev_pop(c).alias(f"std_{name}"), F.min(c).alias(f"min_{name}"), F.max(c).alias(f"max_{name}")]
    median = lambda df, c, name: exact_quantiles(df, [c], [], {"median": 0.5}).select(F.col(f"{c}_median").alias(f"median_{name}"))
    n = stored(table(spark, sf, "documents").select(F.size(whitespace_words(F.col("text"))).cast("long").alias("n")), "lengths")
    pairs = stored(blocked(spark, sf), "pairs")
    used = pairs.select(F.explode(F.array("anchor", "positive", "negative")).alias("id")).distinct().agg(F.count(F.lit(1)).alias("_used"))
    every = chunk_table(spark, sf).agg(F.count(F.lit(1)).alias("_all"))
    out = n.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("total_words"), *five("n", "words")).crossJoin(pairs.agg(F.count(F.lit(1)).alias("n_pairs"), *five("difficulty", "difficulty"))).crossJoin(median(n, "n", "words")).crossJoin(median(pairs, "difficulty", "difficulty")).crossJoin(used).crossJoin(every)  # one row each
    return out.withColumn("coverage", F.col("_used") / F.col("_all")).drop("_used", "_all")
