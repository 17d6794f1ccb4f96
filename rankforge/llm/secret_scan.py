"""Secret scanning: candidates by pattern, false positives removed by a random forest; DataFrame operations only.

A candidate is a run of at least 12 key-like characters with a digit, with password marks (dots among them)
between; after a key word and ``=`` or ``:``, or after Bearer, any value of 12 characters is one, with or without a
digit, and so is a value of 6 with a digit or a mark inside (``&`` too, unless a field's name and ``=`` follow it). In an address what
stands between ``://user:`` and ``@`` is one, from 4 characters. Its features are its length, shares of character classes, transitions between them, distinct characters,
dictionary coverage, whether it stands in a path, and what stands around it: the words before and after, and of
its own word the characters next to it, up to where the next field (``,;&{}``) begins. The forest is trained on labelled findings: a table
``finding, before, word, after, secret``. The tables at hand hold none, so ``labelled_findings`` makes a bounded
set from rules (key formats on one side; card numbers, checksums, identifiers, paths and dates on the other).

Texts without a candidate are passed over by one regular expression; only the others are split into words.

Defined results: a null or blank text has no findings; a null id is passed through; repeated rows give
their findings again; words of any length are taken whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import SPACE_CLASS, checkpoint, text_or_empty

_CLASS, _MARK = r"A-Za-z0-9_+/\-", r".!@$#%^*~"
_RUN = rf"(?<![{_CLASS}])(?<![{_CLASS}][{_MARK}]{{1,8}})(?=[A-Za-z_+/\-{_MARK}]*+[0-9])[{_CLASS}][{_CLASS}{_MARK}]{{10,}}[{_CLASS}]"
#: Words that speak for and against a secret nearby, and common English words.
_FOR = "password|passwd|pwd|secret|token|api|key|auth|bearer|credential|private|access"
#: A value after a key word: more marks, no digit needed; a full stop or question mark at its end isn't part of it.
_IN_VALUE = rf"(?:[{_CLASS}{_MARK}=?|]|&(?![A-Za-z_][A-Za-z0-9_\-]{{0,40}}=))"
_LAST = rf"[{_CLASS}!@$#%^*~=|]"
_VALUE = rf"(?:{_IN_VALUE}{{11,}}{_LAST}|(?=[A-Za-z]{{1,40}}[^A-Za-z\s]|[^A-Za-z\s]){_IN_VALUE}{{5,}}{_LAST})"
#: The password of an address.
_LOGIN = r"(?<=://[^/:@\s]{1,64}:)[^/@\s]{4,}(?=@)"
_NAME = rf"(?i:{_FOR})[A-Za-z0-9_\-]{{0,40}}[\"'`\]\\]{{0,3}}"
_OPEN = r"[\"'`(\\]{0,3}"
#: Within a word, at the start of a word that a key word before leads to, and in whole texts (to pass over the others).
_IN_WORD = rf"(?:{_LOGIN}|(?<=[:=]{_OPEN})(?<={_NAME}[:=]{{1,2}}>?{_OPEN}){_VALUE}|{_RUN})"
_LED = rf"(?:(?<=^{_OPEN}){_VALUE}|{_IN_WORD})"
_LEADS = rf"{_NAME}[:=]{{1,2}}>?$|(?i:bearer)$"
_LEADS_APART = rf"{_NAME}[ ](?:[:=]{{1,2}}>?)$"
_IN_TEXT = rf"{_RUN}|://[^/:@\s]{{1,64}}:[^/@\s]{{4,}}@|{_NAME}{SPACE_CLASS}*[:=]{{1,2}}>?{SPACE_CLASS}*{_OPEN}{_VALUE}|(?i:bearer){SPACE_CLASS}+{_OPEN}{_VALUE}"
#: Characters of the word that stand next to a finding: at least so many where there are as many.
_NEXT = 64
_AGAINST = "commit|sha|md5|checksum|uuid|guid|card|visa|phone|order|isbn|version|revision|date|build|digest|blob|ref|expir|count|length|limit|size|max_|min_|ttl|policy|created|timestamp"
_WORDS = "the|and|that|with|this|from|have|tion|ing|ment|house|time|year|world|school|state|point|home|water|room|mother|area|money|story|fact|month|right|study|book|word|business|issue|side|kind|head|service|friend|father|power|hour|game|line|member|city|team|minute|idea|body|back|parent|face|level|office|door|health|person|art|history|party|result|change|morning|reason|research|girl|guy|moment|air|teacher|force|education|release|image|report|final|test|user|data|file|index|page|static|assets|your|here|required|invalid|missing|default|string|value|null|true|false|enter|field|minimum|manager|session|login|account|number|code|name|mail|config|server|client|public|policy|change|reset|local|host|none|must|sample|dummy|placeholder|password|secret|token"
FEATURES = ["length", "digits", "uppers", "lowers", "turns", "distinct", "vowels", "hex_only", "digits_only", "marks", "prefix", "covered", "in_path", "speaks_for", "speaks_against", "assigned", "quoted", "login", "placeholder"]


def with_features(findings: DataFrame) -> DataFrame:
    """Adds ``FEATURES`` to ``finding, before, word, after`` and, where the word holds more than one place for it, ``left, right``."""
    if "left" not in findings.columns:
        at = F.expr("instr(word, finding)")
        findings = findings.withColumn("left", F.when(at > 0, F.substring("word", F.lit(1), at - 1)).otherwise(F.lit("")))
        findings = findings.withColumn("right", F.when(at > 0, F.substring("word", at + F.length("finding"), F.length("word"))).otherwise(F.lit("")))
    c, n = F.col("finding"), F.length("finding").cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    field = F.regexp_extract("left", "[^,;&{}]*$", 0)
    left = F.when(field.rlike("[=:]"), field).otherwise(F.col("left"))  # a list's items share the name before it
    right = F.regexp_extract("right", r"^[^,;&{}\[\]]*", 0)
    name = F.regexp_extract(c, "^(?:[A-Za-z]+[_-])*", 0)  # a name glued to the value
    near = F.lower(F.concat_ws(" ", "before", left, name, right, "after"))
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    made = {
        "length": F.least(n, F.lit(200.0)),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "turns": F.length(classes) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "vowels": share("[aeiouAEIOU]"),
        "hex_only": flag(c.rlike("^[0-9a-f]+$")),
        "digits_only": flag(c.rlike("^[0-9]+$")),
        "marks": share("[^A-Za-z0-9]"),
        "prefix": flag(c.rlike("^(?:[A-Z]{4}[A-Z0-9]{16}$|[a-z]{2,4}[_-])")),
        "covered": 1 - F.length(F.regexp_replace(F.lower(c), _WORDS, "")) / n,
        "in_path": flag(F.concat(left, c, right).rlike(r"://|^[./~]|/.*/|\\")),
        "speaks_for": flag(near.rlike(_FOR)),
        "speaks_against": flag(near.rlike(_AGAINST)),
        "assigned": flag(F.concat(left, right).rlike("[=:]") | F.col("before").rlike("[=:]$")),
        "quoted": flag(F.concat(left, right).rlike("[\"'`]")),
        "login": flag(F.col("left").rlike("://[^/:@]{1,64}:$") & F.col("right").startswith("@")),
        "placeholder": flag(c.rlike(r"^[$%<{*]|^(.)\1+$|^[Xx*.]{4,}") | F.concat(left, right).rlike(r"\$\{?$|[{]{2}$|<$")),
    }
    return findings.withColumns(made)


def labelled_findings(spark: SparkSession, n: int = 8000) -> DataFrame:
    """``n`` findings of about equally many kinds, made by hashing their number."""
    i = F.col("id")
    hexes = lambda salt: F.sha2(F.concat_ws("-", F.lit(salt), i.cast("string")), 256)
    letters = lambda salt: F.translate(F.base64(F.unhex(F.concat(hexes(salt), hexes(salt + "+")))), "+/=", "xY")
    numbers = lambda salt, k: F.lpad(F.substring(F.abs(F.xxhash64(F.lit(salt), i)).cast("string"), 1, k), k, "4")
    words = F.array(*[F.lit(w) for w in "the is near of house thing running report along final user time".split()])
    some = lambda salt: F.element_at(words, (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(12)) + 1).cast("int"))
    name = lambda salt, options: F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(options))) + 1).cast("int"))
    cut = lambda s, low, high, salt: F.substring(s, F.lit(1), (F.lit(low) + F.pmod(F.xxhash64(F.lit(salt), i), F.lit(high - low + 1))).cast("int"))
    keys = ["password", "passwd", "token", "secret", "api_key", "access_key", "auth_token"]
    plain = ["commit", "sha256", "md5", "checksum", "digest", "ref", "uuid", "order", "card", "build"]
    uuid = F.concat_ws("-", *[F.substring(hexes("u"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    bare = lambda salt: F.translate(letters(salt), "0123456789", "aBcDeFgHiJ")
    part = lambda salt, k: F.substring(letters(salt), 1, k)
    kinds = [  # finding, word before, what precedes it in its word, secret, what follows it there
        (F.concat(F.lit("AKIA"), F.substring(F.upper(F.translate(letters("a"), "019", "XYZ")), 1, 15), F.lit("7")), some("b"), None, 1),
        (cut(hexes("c"), 16, 40, "n"), some("b"), F.concat(name("k", keys), F.lit("=")), 1),
        (cut(hexes("d"), 20, 64, "n"), F.lit("="), F.lit('"'), 1),
        (F.concat(name("p", ["ghp_", "sk_live_", "pk_live_", "xoxb-", "glpat-", "npm_"]), cut(letters("e"), 20, 40, "n")), some("b"), None, 1),
        (cut(letters("f"), 20, 60, "n"), F.concat(name("k", keys), F.lit(":")), None, 1),
        (cut(letters("g"), 16, 40, "n"), some("b"), F.concat(name("k", keys), F.lit("=")), 1),
        (numbers("h", 16), some("b"), None, 0),
        (numbers("i", 13), name("w", plain), None, 0),
        (F.substring(hexes("j"), 1, 40), name("w", plain), None, 0),
        (hexes("l"), F.concat(name("w", plain), F.lit(":")), None, 0),
        (uuid, some("b"), None, 0),
        (F.concat(F.lit("/static/assets/"), some("x"), F.lit("-"), F.substring(hexes("m"), 1, 8)), some("b"), F.lit("https:"), 0),
        (F.concat(some("x"), some("y"), some("z"), numbers("o", 4)), some("b"), None, 0),
        (F.concat(F.lit("2024-0"), F.substring(numbers("q", 1), 1, 1), F.lit("-11T10")), some("b"), None, 0),
        (F.concat(F.lit("eyJ"), part("r", 17), F.lit("."), part("s", 30), F.lit("."), cut(letters("t"), 20, 40, "n")), F.lit("Authorization: Bearer"), None, 1),
        (F.concat(part("ja", 5), name("m1", [".", "!", "@", "$"]), part("jb", 5), name("m2", [".", "!", "@", "$", "#"]), part("jc", 5)), some("b"), F.concat(name("k", keys), F.lit("=")), 1),
        (cut(bare("v"), 14, 40, "n"), some("b"), F.concat(F.lit('{"'), name("k", keys), F.lit('":"')), 1),
        (F.concat(some("x"), F.lit("."), some("y"), numbers("aa", 2), F.lit("@example.com")), some("b"), None, 0),
        (F.concat(F.lit("www."), some("x"), numbers("ab", 2), F.lit("."), some("y"), F.lit(".example.org")), some("b"), None, 0),
        (F.concat(some("x"), F.lit("-"), numbers("ac", 1), F.lit("."), numbers("ad", 2), F.lit("."), numbers("ae", 1), F.lit(".tar.gz")), some("b"), None, 0),
        (F.concat(some("x"), some("y"), some("z"), some("w")), F.concat(name("k", keys), F.lit(":")), None, 0),
        (F.concat(some("x"), F.lit("."), some("y"), F.lit("_"), some("z"), F.lit("."), some("w")), some("b"), F.concat(name("k", keys), F.lit("=")), 0),
        (F.substring(hexes("j"), 1, 40), some("b"), F.concat(F.lit('{"'), name("w", plain), F.lit('":"')), 0),
        (F.concat(cut(letters("sa"), 4, 8, "n"), numbers("sb", 1), name("m3", ["!", "", "#", "", "&x"])), some("b"), F.concat(name("k", keys), F.lit("=")), 1),
        (F.concat(F.lower(cut(bare("sc"), 5, 9, "n")), numbers("sd", 2)), F.concat(name("k", keys), F.lit(":")), None, 1),
        (F.lower(cut(bare("se"), 14, 24, "n")), F.concat(name("k", keys), F.lit(" =")), None, 1),
        (F.concat(cut(letters("sf"), 5, 16, "n"), numbers("sg", 1)), some("b"), F.concat(name("v", ["postgres", "redis", "https", "amqp", "mysql"]), F.lit("://"), some("x"), F.lit(":")), 1, F.concat(F.lit("@"), some("y"), F.lit(".example.net/app"))),
        (cut(numbers("sh", 12), 6, 12, "n"), some("b"), F.concat(name("nn", ["max_tokens", "token_count", "key_size", "token_limit", "password_length"]), F.lit("=")), 0),
        (numbers("si", 14), some("b"), F.concat(name("nx", ["access_token", "token", "key", "secret"]), name("ny", ["_expires", "_created", "_timestamp"]), F.lit("=")), 0),
        (F.concat(name("np", ["your_", "YOUR_", "<your-", "${", "example-", "xxxxxx"]), some("x"), name("nq", ["_here", "-1", "_token", "}"])), some("b"), F.concat(name("k", keys), F.lit("=")), 0),
        (F.concat(name("fa", ["scan_", "photo-", "draft_", "chapter-"]), some("x"), F.lit("_"), numbers("fb", 4), name("fc", [".png", ".pdf", ".txt", ".jpg"])), some("b"), None, 0),
        (F.concat(some("x"), name("nr", ["-", "_", "."]), some("y"), numbers("sj", 1)), F.concat(name("k", keys), F.lit(":")), None, 0),
    ]
    kind = F.pmod(i, F.lit(len(kinds)))
    pick = lambda column: F.element_at(F.array(*[column(k) for k in kinds]), (kind + 1).cast("int"))
    rows = spark.range(0, n, 1, 1).select(
        pick(lambda k: k[0]).alias("finding"), pick(lambda k: k[1]).alias("before"),
        pick(lambda k: F.concat(k[2] if k[2] is not None else F.lit(""), k[0], k[4] if len(k) > 4 else F.lit(""))).alias("word"), some("after").alias("after"), pick(lambda k: F.lit(k[3])).alias("secret"),
    )
    return rows


def _vectors(findings: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(with_features(findings))


def train_forest(labelled: DataFrame, trees: int = 40, depth: int = 9, seed: int = 11) -> RandomForestClassificationModel:
    """A forest over a bounded table of labelled findings (one partition, so that a rerun gives the same trees)."""
    rows = _vectors(labelled.coalesce(1)).select("_features", F.col("secret").cast("double").alias("label"))
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, maxBins=32, subsamplingRate=0.8)
    return forest.fit(checkpoint(rows))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, word_index, finding_index, finding, before, word, after, left, right``: every candidate of every text."""
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).where(F.col("_text").rlike(_IN_TEXT))
    rows = rows.select("_id", F.filter(F.split("_text", f"{SPACE_CLASS}+"), lambda w: w != "").alias("_words"))
    around = F.transform("_words", lambda w, i: F.struct(F.get("_words", i - 2).alias("p2"), F.get("_words", i - 1).alias("p1"), w.alias("word"), F.get("_words", i + 1).alias("after"), i.alias("word_index")))
    leads = lambda p2, p1: F.coalesce(p1.rlike(_LEADS), F.lit(False)) | F.coalesce(F.concat_ws(" ", p2, p1).rlike(_LEADS_APART), F.lit(False))
    hits = rows.select("_id", F.explode(F.filter(around, lambda x: x["word"].rlike(_IN_WORD) | (x["word"].rlike(_LED) & leads(x["p2"], x["p1"])))).alias("_w")).select("_id", "_w.*")

    def parts(group: int) -> Column:
        """The finding (2) and what stands to its left (1) and right (3), found together; the left part is read backwards from each place."""
        whole = lambda body: rf"(?={body})(?<=(^[\s\S]{{0,{_NEXT}}}|[\s\S]{{{_NEXT},{2 * _NEXT}}}))({body})(?=([\s\S]{{0,{_NEXT}}}))"
        every = lambda body: F.regexp_extract_all("word", F.lit(whole(body)), F.lit(group))
        return F.when(leads(F.col("p2"), F.col("p1")), every(_LED)).otherwise(every(_IN_WORD))

    found = hits.select("*", F.posexplode(F.arrays_zip(parts(2).alias("finding"), parts(1).alias("left"), parts(3).alias("right"))).alias("finding_index", "_f"))
    return found.select("_id", "word_index", "finding_index", "_f.finding", F.concat_ws(" ", "p2", "p1").alias("before"), "word", F.coalesce("after", F.lit("")).alias("after"), "_f.left", "_f.right")


def scan_secrets(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per candidate: ``id_col, word_index, finding_index, finding, score, secret``."""
    scored = model.transform(_vectors(candidates(docs, id_col, text_col)))
    p = F.round(vector_to_array("probability")[1], 6)
    return scored.select(F.col("_id").alias(id_col), "word_index", "finding_index", "finding", p.alias("score"), (p >= threshold).alias("secret"))
