"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a run of at least ``SHORTEST`` characters of the alphabets that keys
are written in, with a digit or of at least ``LONGEST_PLAIN`` characters; and any value
of at least ``SHORTEST_VALUE`` characters of whatever alphabet that is assigned to a
secret's name: up to its closing quote or, without quotes, to a blank or the next
``&name=``, less closing signs at its end. Its features are

- length, shares of digits, capitals, small letters and signs, distinct characters,
  and how often the kind of character changes;
- the mean log share of its character transitions among all words of the corpus;
- dictionary coverage: the share of its four-character parts among the ``PARTS`` most
  frequent ones of the corpus' words;
- the path (its depth, words such as test or example, a hash) and the neighbouring
  words (an assignment to a name such as password, quotes, hashes of the words).

The forest is learned from labelled findings, at most ``SAMPLE`` by a hash. Where no
labels are given, ``sure_labels`` takes the findings that are beyond doubt: known key
forms and assignments to a secret's name, against plain words and plain numbers. The
word counts cover all documents. Only DataFrame functions and the forest of
pyspark.ml are used.

Rows: null and empty texts have no findings. Repeated rows give their findings each;
findings of one word follow in order. Other columns but ``source`` are ignored, a
missing or null source is an empty path. Without labelled findings of both kinds every
candidate is kept as a secret with probability 1. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.session import materialise

SHORTEST = 16
LONGEST_PLAIN = 20
SHORTEST_VALUE = 6
PARTS = 20_000
SAMPLE = 20_000
TREES, DEPTH = 20, 6
RUN = rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}"
NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credentials?|private[_-]?key"
ASSIGNED = rf"(?i)(?:^|[^a-z])[a-z_-]*(?:{NAMES})[\"']?\s*[:=]\s*[\"']?$"
# where the value of an assignment begins, in words joined by single blanks
VALUE = rf"(?i)(?<=(?:{NAMES})[\"']? ?[:=] ?)(?=(\"[^\"\s]+|'[^'\s]+|[^\"'\s]\S*))"
LAST_VALUE = VALUE + r"(?=\S*$)"  # in the last of the words
KNOWN = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abpr]-[A-Za-z0-9-]{20,}$|^sk_live_[A-Za-z0-9]{16,}$"
FEATURES = (
    "length digits capitals small signs distinct changes hex transitions coverage "
    "path_depth path_test path_hash assigned quoted before_hash after_hash"
).split()


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, source, word_no, run_no, candidate, context, after), one row per candidate.

    ``context`` is the two words before and what stands before the candidate in its word.
    Values that are no runs are numbered after the runs of their word.
    """
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    rows = docs.where(F.rlike("text", F.lit(RUN)) | F.rlike("text", F.lit(rf"(?i)(?:{NAMES})[\"']?\s*[:=]"))).select(
        "doc_id", F.coalesce(source, F.lit("")).alias("source"),
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
    )
    get = lambda k: F.coalesce(F.get("words", k), F.lit(""))
    # an assignment needs its sign in the word or at the end of what stands before it
    signed = lambda k: F.rlike(get(k), F.lit("[:=]")) | F.rlike(get(k - 1), F.lit("[:=]$"))
    places = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1),
        lambda k: (F.length(F.get("words", k)) >= SHORTEST) & F.rlike(F.get("words", k), F.lit(RUN))
        | signed(k) & F.rlike(F.concat_ws(" ", get(k - 2), get(k - 1), get(k)), F.lit(LAST_VALUE)),
    )
    rows = rows.select("doc_id", "source", "words", F.explode(places).alias("word_no"))
    word = lambda k: get(F.col("word_no") + k)
    rows = rows.select(
        "doc_id", "source", "word_no", word(0).alias("word"),
        F.concat_ws(" ", word(-2), word(-1)).alias("before"), word(1).alias("after"),
    )
    runs = F.regexp_extract_all("word", F.lit(f"({RUN})"), 1)
    found = F.regexp_extract_all(F.concat_ws(" ", "before", "word"), F.lit(LAST_VALUE), 1)
    quoted = lambda v: F.rlike(v, F.lit("^[\"']"))
    ends = F.lit("(?:&[A-Za-z0-9_.-]+=.*|[,;.)}\\]>\"'`]+)$")
    values = F.transform(found, lambda v: F.when(quoted(v), F.substr(v, F.lit(2))).otherwise(F.regexp_replace(v, ends, F.lit(""))))
    kept = lambda c: F.rlike(c, F.lit("[0-9]")) | (F.length(c) >= LONGEST_PLAIN)
    rows = rows.select("*", runs.alias("runs"), values.alias("values"))
    values = F.filter(
        "values", lambda v: (F.length(v) >= SHORTEST_VALUE) & ~(F.array_contains("runs", v) & kept(v))
    )
    one = lambda c, value: F.struct(c.alias("candidate"), F.lit(value).alias("value"))
    every = F.concat(F.transform("runs", lambda c: one(c, False)), F.transform(values, lambda c: one(c, True)))
    rows = rows.select("*", F.posexplode(every).alias("run_no", "found")).select("*", "found.*")
    # a value stands after its sign, where its name may hold the same characters
    place = F.position(F.col("candidate"), F.col("word"))
    for sign in ("=", ":", "=\"", ":\"", "='", ":'"):
        at = F.position(F.concat(F.lit(sign), F.col("candidate")), F.col("word"))
        place = F.when(F.col("value") & (at > 0), at + len(sign)).otherwise(place)
    return rows.where(F.col("value") | kept(F.col("candidate"))).select(
        "doc_id", "source", "word_no", "run_no", "candidate",
        F.concat_ws(" ", "before", F.substr(F.col("word"), F.lit(1), place - 1)).alias("context"), "after",
    )


def char_kind(text: Column) -> Column:
    """Small letters stay, digits and other characters become one sign each."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), "[^a-z0]", "~")


def parts_of(text: Column, size: int) -> Column:
    n = F.length(text) - size
    return F.when(
        n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda k: F.substr(text, k + 1, F.lit(size)))
    ).otherwise(F.array().cast("array<string>"))


def known_parts(docs: DataFrame) -> DataFrame:
    """(part, value): log shares of two-character parts, and 1 for the frequent four-character
    ones, counted over the words of all documents. Bounded: 28 * 28 and PARTS rows."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}0-9]+")).alias("word")).where("word <> ''")
    words = words.groupBy("word").agg(F.count("*").alias("n"))
    words = materialise(words.select(char_kind(F.col("word")).alias("word"), "n"), "words")
    parts = lambda size: words.select(F.explode(parts_of(F.col("word"), size)).alias("part"), "n").groupBy("part").agg(
        F.sum("n").alias("n")
    )
    pairs = parts(2)
    total = pairs.select(F.substr("part", F.lit(1), F.lit(1)).alias("first"), "n").groupBy("first").agg(F.sum("n").alias("all"))
    shares = pairs.withColumn("first", F.substr("part", F.lit(1), F.lit(1))).join(total, "first").select(
        "part", F.log(F.col("n") / F.col("all")).alias("value")
    )
    frequent = parts(4).orderBy(F.desc("n"), "part").limit(PARTS).select("part", F.lit(1.0).alias("value"))
    return shares.unionByName(frequent)


def with_features(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds the columns of FEATURES to candidates."""
    known = materialise(known_parts(docs), "parts")
    texts = found.select("candidate").distinct()
    kinds = char_kind(F.col("candidate"))
    parts = texts.select("candidate", F.explode(F.concat(parts_of(kinds, 2), parts_of(kinds, 4))).alias("part"))
    # at most 784 + PARTS rows are sent to the tasks
    seen = parts.join(F.broadcast(known), "part", "left")
    two = F.length("part") == 2
    shape = seen.groupBy("candidate").agg(
        F.avg(F.when(two, F.coalesce("value", F.lit(-12.0)))).alias("transitions"),
        F.avg(F.when(~two, F.coalesce("value", F.lit(0.0)))).alias("coverage"),
    )
    c, n = F.col("candidate"), F.length("candidate")
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    bucket = lambda text: F.pmod(F.xxhash64(F.lower(text)), F.lit(64)).cast("double")
    last = F.regexp_extract("context", r"(\S*)\s*$", 1)
    return found.join(shape, "candidate").select(
        *found.columns, "transitions", "coverage",
        n.cast("double").alias("length"),
        count("[0-9]").alias("digits"), count("[A-Z]").alias("capitals"), count("[a-z]").alias("small"),
        count("[^A-Za-z0-9]").alias("signs"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("distinct"),
        count("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])").alias("changes"),
        F.rlike(c, F.lit("^[0-9a-fA-F]+$")).cast("double").alias("hex"),
        F.regexp_count("source", F.lit("/")).cast("double").alias("path_depth"),
        F.rlike("source", F.lit("(?i)test|example|sample|mock|fixture")).cast("double").alias("path_test"),
        bucket(F.col("source")).alias("path_hash"),
        F.rlike("context", F.lit(ASSIGNED)).cast("double").alias("assigned"),
        F.rlike("context", F.lit("[\"'`]$")).cast("double").alias("quoted"),
        bucket(last).alias("before_hash"), bucket(F.col("after")).alias("after_hash"),
    )


def sure_labels(found: DataFrame) -> Column:
    """1 and 0 for findings beyond doubt, else null."""
    c = F.col("candidate")
    plain = F.rlike(c, F.lit("^[A-Za-z]+$")) | F.rlike(c, F.lit("^[0-9/_+-]+$"))
    assigned = F.rlike("context", F.lit(ASSIGNED))
    return (
        F.when(F.rlike(c, F.lit(KNOWN)) | (assigned & F.rlike(c, F.lit("[0-9]")) & F.rlike(c, F.lit("[A-Za-z]"))), 1)
        .when(plain & ~assigned, 0)
    )


def train(labelled: DataFrame, sample: int = SAMPLE) -> RandomForestClassificationModel | None:
    """A forest from findings with features and ``label``; None without both labels."""
    rows = labelled.where("label IS NOT NULL").select(*FEATURES, F.col("label").cast("double").alias("label"), "candidate", "doc_id")
    both = None
    for label in (0, 1):  # half of the sample for each
        some = rows.where(F.col("label") == label)
        some = some.orderBy(F.xxhash64("candidate", "doc_id"), "candidate", "doc_id").limit(sample // 2)
        both = some if both is None else both.unionByName(some)
    # one partition of bounded size, so that the draws of the trees repeat
    both = materialise(both.coalesce(1), "labelled").coalesce(1).fillna(0.0, FEATURES)
    kinds = {r["label"] for r in both.select("label").distinct().collect()}
    if len(kinds) < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(both)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7).fit(vectors)


def scan(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, word_no, run_no, candidate, probability, is_secret) of every candidate.

    ``labels`` (candidate, label) are findings that someone has judged.
    """
    found = materialise(candidates(docs), "candidates")
    found = materialise(with_features(found, docs), "findings")
    if labels is None:
        judged = found.withColumn("label", sure_labels(found))
    else:
        judged = found.join(labels.groupBy("candidate").agg(F.max("label").alias("label")), "candidate")
    model = train(judged)
    names = ["doc_id", "word_no", "run_no", "candidate"]
    if model is None:
        return found.select(*names, F.lit(1.0).alias("probability"), F.lit(True).alias("is_secret"))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found.fillna(0.0, FEATURES))
    scored = model.transform(rows).withColumn("p", F.round(vector_to_array("probability")[1], 6))
    return scored.select(*names, F.col("p").alias("probability"), (F.col("p") >= threshold).alias("is_secret"))
