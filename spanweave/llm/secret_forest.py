"""Secret scan: a random forest decides which long tokens are secrets.

Candidates are runs of 16 or more of ``[A-Za-z0-9+/_-]`` and the ``=`` that pad
them; an ``=`` before a value parts the name from it.  A forest judges each
by its length and make-up, the likelihood of its character transitions, how much
of it dictionary words cover, the path it stands in and the words around it; it
is trained on labelled findings and its negatives are the false positives that
the scan leaves out.

Dictionary and transitions are counted over all texts: the words of 3 to 15
letters that occur five times or more.  From them come two tables bounded by the
alphabet (28 × 28 transitions, 26^3 letter triples), which are put into the plan
as constants.  Training takes at most ``max_labelled`` findings of each label.
Everything runs in the JVM: SQL expressions and Spark ML.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, lower_ascii, materialize

MIN_LENGTH = 16
CANDIDATE = r"([A-Za-z0-9+/_-]{16,}+(?:={1,2}(?!=*[\"']?[A-Za-z0-9+/_-]))?)"  # an equals sign only as padding
ASSIGNS = r"^=+[\"']?[A-Za-z0-9+/_-]"
CREDENTIAL = r"(?i)(token|secret|passw|pwd|credential|auth|bearer|private|(api|access|signing|encryption)[_-]?key|[?&]key=|\bkey is\b)"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|changeme|your|xxxx|0{8}|1234567)"
# Credentials that their issuer's prefix and length give away.
KNOWN = (r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}"
         r"|AIza[A-Za-z0-9_-]{35}|[srp]k_live_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{32,}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,})$")
UUID = r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"
CHECKSUM = r"(?i)(commit|\bsha[-_]?[0-9]|md5|checksum|digest|\bhash|etag|integrity|revision|\bcrc)"
KEY = r"(?i)(?<![a-z])keys?(?![a-z])"
CONFIG_PATH = r"(?i)\.(env|ya?ml|json|toml|ini|cfg|conf|pem|key|properties|tf|sh|py|js|ts|go|java|rb|php)$"
TEST_PATH = r"(?i)(test|spec|example|sample|doc|fixture|mock)"
SWITCH = "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
MIN_DICTIONARY_COUNT = 5
MAX_LABELLED = 20_000
REDACTED = "[SECRET]"
LETTERS = 26
CLASSES = 28  # letters, digits, anything else
FEATURES = ["length", "digits", "capitals", "distinct", "switches", "transition", "coverage", "path_depth", "path_config", "path_test", "path_hash",
            "credential_before", "assigned", "quoted", "placeholder", "assigns", "known", "random", "key_before", "checksum", "letters_before", "letters_after"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, text_key, path, word_no, secret, word, before2, before1, after): one row per candidate.

    The generator is an outer one, so that no copy of the split lands in a filter
    below it; only words of 16 or more characters get past the next step.
    """
    split = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"),
                        F.split(F.coalesce(F.col(text_col), F.lit("")), f"{SPACE_CLASS}+").alias("words"))
    each = split.select("doc_id", "path", "text", "words", F.posexplode_outer("words").alias("word_no", "word")).where(F.length("word") >= MIN_LENGTH)
    found = each.select("doc_id", "path", "text", "word_no", "word", F.get("words", F.col("word_no") - 2).alias("before2"), F.get("words", F.col("word_no") - 1).alias("before1"),
                        F.get("words", F.col("word_no") + 1).alias("after"), F.explode_outer(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(1))).alias("secret"))
    return found.where("secret is not null").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), "path", "word_no", "secret", "word", "before2", "before1", "after")


def dictionary(docs: DataFrame, text_col: str = "text", min_count: int = MIN_DICTIONARY_COUNT) -> DataFrame:
    """word, n: lower-cased words of 3 to 15 ASCII letters that occur often enough, closing punctuation taken off."""
    tokens = docs.select(F.split(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), f"{SPACE_CLASS}+").alias("words")).select(F.explode_outer("words").alias("word"))
    plain = tokens.where(F.length("word").between(3, 16)).select(F.regexp_extract("word", r"^([a-z]{3,15})[.,;:!?]?$", 1).alias("word")).where("word != ''")
    return plain.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _codes(s: Column) -> Column:
    """Class of each character: 0-25 a letter, 26 a digit, 27 anything else."""
    def code(i: Column) -> Column:
        c = F.ascii(F.substring(s, i, F.lit(1)))
        return F.when(c.between(97, 122), c - 97).when(c.between(65, 90), c - 65).when(c.between(48, 57), 26).otherwise(27)
    return F.transform(F.sequence(F.lit(1), F.length(s)), code)


def language_tables(words: DataFrame) -> tuple[bytes, bytes]:
    """(transitions, triples) of a dictionary, a byte per entry.

    transitions[28 a + b] is 10 × -log2 P(b | a), at most 120; triples[676 a + 26 b + c]
    is 1 when the letters stand side by side in a dictionary word.
    """
    codes = words.select("n", _codes(F.col("word")).alias("codes"))
    index = F.sequence(F.lit(0), F.size("codes") - 2)
    pairs = codes.select("n", F.explode_outer(F.transform(index, lambda i: F.get("codes", i) * CLASSES + F.get("codes", i + 1))).alias("pair"))
    counts = [[0.5] * CLASSES for _ in range(CLASSES)]
    for pair, n in pairs.groupBy("pair").agg(F.sum("n")).where("pair is not null").collect():  # at most 28 × 28 rows
        counts[pair // CLASSES][pair % CLASSES] += n
    transitions = bytes(min(120, round(-10 * math.log2(x / sum(row)))) for row in counts for x in row)
    triple_index = F.sequence(F.lit(0), F.size("codes") - 3)
    triples = codes.select(F.explode_outer(F.transform(triple_index, lambda i: F.get("codes", i) * 676 + F.get("codes", i + 1) * 26 + F.get("codes", i + 2))).alias("triple"))
    flags = bytearray(LETTERS ** 3)
    for (triple,) in triples.where("triple is not null").distinct().collect():  # at most 26^3 rows
        flags[triple] = 1
    return transitions, bytes(flags)


def random_cost(transitions: bytes) -> float:
    """Mean cost of a pair of letters, half way between text like the dictionary's and letters drawn at random."""
    cost = [[transitions[CLASSES * a + b] for b in range(LETTERS)] for a in range(LETTERS)]
    chance = [[2 ** (-x / 10) for x in row] for row in cost]
    share = [1 / LETTERS] * LETTERS
    for _ in range(50):  # how often each letter comes, when letters follow each other by the table
        share = [sum(share[a] * chance[a][b] / sum(chance[a]) for a in range(LETTERS)) for b in range(LETTERS)]
    text = sum(share[a] * sum(c * x for c, x in zip(chance[a], cost[a])) / sum(chance[a]) for a in range(LETTERS))
    return (text + sum(map(sum, cost)) / LETTERS ** 2) / 2


def _entry(table: bytes, index: Column) -> Column:
    """The byte of a constant table at ``index``."""
    return F.ascii(F.substring(F.lit(table), index + 1, F.lit(1)).cast("string"))


def with_features(found: DataFrame, tables: tuple[bytes, bytes]) -> DataFrame:
    """Candidates + the columns ``FEATURES``, all doubles without nulls."""
    transitions, triples = tables
    s, n = F.col("secret"), F.length("secret")
    share = lambda pattern: F.regexp_count("secret", F.lit(pattern)) / n
    around = lambda c: F.coalesce(F.col(c), F.lit(""))
    mean = lambda values, default: F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(default)
    df = found.withColumn("codes", _codes(s))
    pair_scores = F.transform(F.sequence(F.lit(0), F.size("codes") - 2),
                              lambda i: _entry(transitions, F.get("codes", i) * CLASSES + F.get("codes", i + 1)).cast("double"))

    def covered(i: Column) -> Column:
        a, b, c = (F.get("codes", i + k) for k in range(3))
        inside = (a < LETTERS) & (b < LETTERS) & (c < LETTERS)
        return F.when(inside, _entry(triples, F.when(inside, a * 676 + b * 26 + c).otherwise(0)).cast("double")).otherwise(0.0)

    prefix = F.call_function("substring_index", F.col("word"), s, F.lit(1))
    suffix = F.substring(F.col("word"), F.length(prefix) + n + 1, F.length("word"))
    path, context = around("path"), F.concat_ws(" ", around("before2"), around("before1"), prefix)
    columns = {
        "length": n,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "distinct": F.size(F.array_distinct("codes")) / n,
        "switches": share(SWITCH),
        "transition": mean(pair_scores, F.lit(0.0)),
        "coverage": mean(F.transform(F.sequence(F.lit(0), F.size("codes") - 3), covered), F.lit(0.0)),
        "path_depth": F.size(F.split(path, "/")),
        "path_config": path.rlike(CONFIG_PATH),
        "path_test": path.rlike(TEST_PATH),
        "path_hash": F.pmod(F.xxhash64(path), F.lit(16)),
        "credential_before": context.rlike(CREDENTIAL),
        "assigned": context.rlike(r"[=:]"),
        "quoted": F.col("word").rlike("[\"']"),
        "placeholder": F.concat_ws(" ", context, s).rlike(PLACEHOLDER),
        "key_before": context.rlike(KEY),
        "checksum": context.rlike(CHECKSUM),
        "assigns": suffix.rlike(ASSIGNS) & ~prefix.rlike("[=:][\"']?$"),
        "known": s.rlike(KNOWN),
        "random": F.when(s.rlike("^[A-Za-z]+$"), mean(pair_scores, F.lit(0.0)) > random_cost(transitions)).otherwise(
            s.rlike("[A-Za-z]") & s.rlike("[0-9]") & (share(SWITCH) >= 0.1)),
        "letters_before": F.length(F.regexp_replace(around("before1"), "[^A-Za-z]", "")) / F.greatest(F.length(around("before1")), F.lit(1)),
        "letters_after": F.length(F.regexp_replace(around("after"), "[^A-Za-z]", "")) / F.greatest(F.length(around("after")), F.lit(1)),
    }
    return df.select(*found.columns, *[c.cast("double").alias(name) for name, c in columns.items()])


def label_findings(featured: DataFrame) -> DataFrame:
    """The labelling rules used where no labelled findings are at hand: + label, null where the evidence does not decide.

    Secrets (1): an issuer's known shape; a candidate with letters and digits, or of
    letters that no word would have, that is assigned to a credential's name; random
    letters and digits after a credential's name.  False
    positives (0): placeholders, names of what follows, UUIDs and checksums without a
    credential's name before them, values assigned to another name than a credential's
    or a key's, words without a credential's name before them, and whatever is not
    random: numbers and identifiers.  Random candidates without either evidence have
    no label: the forest decides them.
    """
    secret, yes = F.col("secret"), lambda c: F.col(c) > 0
    named = yes("credential_before") & yes("assigned")
    mixed = secret.rlike("[0-9]") & secret.rlike("[A-Za-z]")
    other = yes("checksum") | secret.rlike(UUID) | (yes("assigned") & ~yes("key_before")) | secret.rlike("^[A-Za-z]+$")
    identifier = other & ~yes("credential_before")
    label = (F.when(secret.rlike(PLACEHOLDER) | (yes("assigns") & ~yes("known")), 0.0).when(yes("known"), 1.0)
             .when(named & ~yes("placeholder") & (mixed | yes("random")), 1.0)
             .when(yes("credential_before") & ~yes("placeholder") & ~yes("checksum") & mixed & yes("random"), 1.0).when(identifier | ~yes("random"), 0.0))
    return featured.withColumn("label", label)


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED, trees: int = 40, depth: int = 8, seed: int = 0) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (``FEATURES`` and label 0/1), at most ``max_labelled`` of each label.

    The findings used are chosen by hash, so reruns agree.  None when a label is missing.
    """
    order = F.xxhash64("secret", "word_no", "text_key")
    sample = [labelled.where(F.col("label") == v).orderBy(order, "secret", "text_key", "word_no").limit(max_labelled).select(*FEATURES, "label") for v in (0, 1)]
    rows = materialize(sample[0].unionByName(sample[1]).coalesce(1).sortWithinPartitions(*FEATURES, "label"), "forest-sample")
    if rows.select("label").distinct().count() < 2:
        return None
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(data)


def judge(featured: DataFrame, forest: RandomForestClassificationModel) -> DataFrame:
    """Candidates + score, the forest's probability of a secret."""
    scored = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured))
    return scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")


FINDINGS = "doc_id, text_key, path, word_no, secret, score"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", labelled: DataFrame | None = None,
                 threshold: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Findings that the forest holds for secrets: doc_id, text_key (MD5 of the text), path, word_no, secret, score.

    ``labelled`` has the columns of ``candidates`` and label (1 a secret, 0 a false
    positive); without it the candidates are labelled by ``label_findings``; those it
    leaves open are the forest's to decide, and known shapes are findings in any case.

    Defined results: null and empty texts have no candidates; a null path or id is
    kept as null; a secret that occurs twice in a text is two findings; repeated
    rows give their findings each; when either label is missing there is no forest
    and only what ``label_findings`` holds for a secret is found, with ``labelled`` nothing; an empty table gives no rows; columns not named, whatever
    they are called, are ignored.
    """
    tables = language_tables(materialize(dictionary(docs, text_col), "forest-dictionary"))
    featured = materialize(with_features(candidates(docs, id_col, text_col, path_col), tables), "forest-candidates")
    examples = label_findings(featured) if labelled is None else with_features(labelled.drop("label"), tables).join(
        labelled.select("secret", "text_key", "word_no", "label").distinct(), ["secret", "text_key", "word_no"])
    forest = train(examples, max_labelled)
    columns = FINDINGS.split(", ")
    if forest is None:
        return examples.withColumn("score", F.lit(1.0)).where((F.col("label") == 1) & F.lit(labelled is None)).select(*columns)
    judged = judge(featured if labelled is not None else examples, forest)
    if labelled is None:
        judged = judged.withColumn("score", F.when((F.col("known") > 0) & (F.col("label") == 1), 1.0).otherwise(F.col("score")))
    return judged.where(F.col("score") >= threshold).select(*columns)


def redact(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every occurrence of a document's secrets replaced by ``REDACTED``; columns and rows as they are."""
    secrets = findings.groupBy(F.col("doc_id").alias("__secret_id"), F.col("text_key").alias("__secret_key")).agg(
        F.sort_array(F.collect_set(F.struct((-F.length("secret")).alias("n"), "secret"))).alias("__secrets"))  # the secrets of one text
    secrets = materialize(secrets, "secrets")
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    # The findings grow with the documents: never broadcast.
    joined = docs.join(secrets.hint("merge"), F.col(id_col).eqNullSafe(F.col("__secret_id")) & (key == F.col("__secret_key")), "left")
    clean = F.when(F.col("__secrets").isNull(), F.col(text_col)).otherwise(
        F.aggregate("__secrets", F.col(text_col), lambda t, s: F.replace(t, s["secret"], F.lit(REDACTED))))
    return joined.select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])
