"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are found with one regular expression. Each gets features of its length, of its character transitions, of how
much of it dictionary words cover, and of its path and the words beside it, which are hashed; a random forest trained on
labelled findings gives the probability that it is a secret. The dictionary holds the commonest words of the corpus. The
forest is trained by the ML library and then written as one expression, so a text is matched, judged and redacted in a single
pass where it lies: no Python runs on the executors, nothing is joined, and no document or source gathers in one task.

Defined results: null and empty texts have no findings; a null path counts as ""; overlapping candidates do not occur, as
matches follow one another; repeated rows have their own findings; other columns are dropped by scan and kept by redact,
whatever their names. Offsets count characters. The noncharacter U+FFFF reads as U+FFFE in texts with findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import let, numbered_columns, pick, sums_before
from tidemark.scratch import delete, shared_folder

# Public formats of keys, and how secrets are assigned to names.
ASSIGNED = r"(?i:passw(?:or)?d|passphrase|secret|token|api[_-]?key|access[_-]?key|credential|pwd)[\"']?[ \t]*+\s{0,2}[:=][ \t]*+\s{0,2}[\"']?"
#: A private key runs to its END line or, where there is none, over the lines of base64 after its header.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?:\s{1,4}[A-Za-z0-9+/]{40,}={0,2}(?![A-Za-z0-9+/=]))+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/]{1,39}={0,2}(?=[ \t]*(?:\r?\n|$)))?)?"
)
PATTERN = (
    rf"{PRIVATE_KEY}"
    r"|\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
    r"|\bgh[pousr]_[A-Za-z0-9]{36,}"
    r"|\bxox[abprs]-[A-Za-z0-9-]{10,}"
    r"|\bAIza[0-9A-Za-z_-]{35}"
    r"|\bsk_(?:live|test)_[0-9A-Za-z]{16,}"
    r"|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"
    rf"|{ASSIGNED}[^\s\"',;<>#]{{6,}}"
    r"|\b(?=[A-Za-z_]{0,30}[0-9])(?=[0-9_]{0,30}[A-Za-z])[A-Za-z0-9_]{24,}\b"
)
KNOWN_FORM = r"^(?:-----BEGIN|(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_|xox[abprs]-|AIza|sk_(?:live|test)_|eyJ)"
PLACEHOLDER = r"(?i)^(?:[x*.#_-]+|\$\{?.*|%.*|<.*|\{\{.*|(?:your|my|the|some|insert|enter|change)[_-]?.*|change_?me.*|none|null|true|false|undefined|example.*|.*example|password\d{0,4}|secret\d{0,4}|0+|1234567.*)$"
WORDS = (
    "access account admin alpha api auth beta build cache change class client code config content count data database default delta demo dev "
    "document dummy email enter env error event example false field file filter first foo function get git hash host http index info input insert "
    "item key label lambda last length level library line list live local log login main map master memory message model module my name network new "
    "node none null number object omega open option output package param pass password path placeholder prod profile project query random read "
    "release request response result root sample script secret select server service session setting some source staging state static status string "
    "system table temp template test text the theme time token true type undefined update url user value version view web word work write your"
).split()
COMMON_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"
#: Words that stand beside harmless values; the prose of the findings made by rule does without them.
TELLING = ("beta", "build", "commit", "demo", "digest", "dummy", "example", "git", "hash", "sample", "test", "version")
DENSE = ("size", "transitions", "digits", "upper", "lower", "other", "variety", "hex", "covered", "letter_pairs", "known", "placeholder", "named")
#: Buckets of the hashed words beside a finding and of the hashed parts of its path; words on either side that count.
NEAR, PLACE, BEFORE, AFTER = 128, 32, 4, 2
#: Words of the corpus in the dictionary at most, the least letters of one, and the least number of texts that hold it.
DICTIONARY, LETTERS, TEXTS = 400, 4, 20
#: Parts a text into gaps and matches; no text holds it when it is matched.
_MARK = "\uffff"
FINDING = "path string, before string, secret string, after string, label double"


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Labelled findings from a CSV file with a header: path (of the file), before and after (the text beside the value, with the
    name that it is assigned to), secret (the value itself) and label (1: a secret, 0: not)."""
    return spark.read.schema(FINDING).options(header=True, multiLine=True, escape='"', mode="FAILFAST").csv(path)


def top_words(df: DataFrame, text_col: str = "text", n: int = DICTIONARY, least: int = TEXTS) -> list[str]:
    """The words of letters a-z that most texts hold, ``least`` of them or more; counted over all texts."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z]{{{LETTERS},}}"), F.lit(0)))
    counts = pick(df, text=text_col).select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return [r["w"] for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(n).collect()]


def _buckets(words: Column, n: int) -> Column:
    return F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(n)))


def features(path: Column, before: Column, secret: Column, after: Column, dictionary: str) -> Column:
    """array<double>: DENSE, then whether a word beside the value, and a part of its path, falls in each bucket. None is null."""
    size = F.greatest(F.length(secret), F.lit(1))
    share = lambda pattern: F.regexp_count(secret, F.lit(pattern)) / size
    changes = F.regexp_count(secret, F.lit(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    dense = {
        "size": F.ln(size.cast("double")), "transitions": changes / size, "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"),
        "other": share("[^A-Za-z0-9]"), "variety": F.size(F.array_distinct(F.split(secret, ""))) / F.least(size, F.lit(64)), "hex": flag(secret.rlike("^[0-9a-f]{16,}$")),
        "covered": 1 - F.length(F.regexp_replace(F.lower(secret), dictionary, "")) / size, "letter_pairs": F.regexp_count(F.lower(secret), F.lit(f"(?=(?:{COMMON_PAIRS}))")) / size, "known": flag(secret.rlike(KNOWN_FORM)),
        "placeholder": flag(secret.rlike(PLACEHOLDER)), "named": flag(before.rlike(f"{ASSIGNED}$")),
    }
    words = lambda text: F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z][a-z0-9]*"), F.lit(0))
    near = let(words(before), lambda w: F.slice(w, F.greatest(F.lit(1), F.size(w) - BEFORE + 1), F.lit(BEFORE)))
    beside = _buckets(F.concat(near, F.slice(words(after), 1, AFTER)), NEAR)
    place = _buckets(words(path), PLACE)
    bits = lambda found, n: let(found, lambda b: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.array_contains(b, j).cast("double")))
    return F.concat(F.array(*[dense[k].cast("double") for k in DENSE]), bits(beside, NEAR), bits(place, PLACE))


def labelled_findings(spark: SparkSession, n: int = 3000, words: list[str] | None = None) -> DataFrame:
    """(path, before, secret, after, label): findings made by rule, half of them secrets, the same each time.

    They stand in for a labelled table where none is given: read_findings reads one of one's own. Prose around a finding is
    drawn from ``words``.
    """
    prose = words or [w for w in WORDS if w not in TELLING]
    block = F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), F.repeat(F.concat(F.base64(F.unhex(F.concat(F.sha2(F.concat(F.lit("k1"), F.col("id").cast("string")), 256), F.lit("ab")))), F.lit("\n")), 6), F.lit("-----END PRIVATE KEY-----"))
    made = spark.range(0, n, 1, 1)
    h = lambda k: F.sha2(F.concat_ws(":", F.lit(k), F.col("id").cast("string")), 256)
    pickone = lambda k, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(xs))) + 1).cast("int"))
    letters = lambda k, m: F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(h(k), h(k + "'")))), "[+/=]", ""), 1, m)
    digits = lambda k, m: F.substring(F.regexp_replace(h(k), "[a-f]", ""), 1, m)
    word = lambda k: pickone(k, WORDS)
    text = lambda k: F.concat_ws(" ", *[pickone(f"{k}{j}", prose) for j in range(4)])
    kind = F.pmod(F.xxhash64(F.lit("kind"), "id"), F.lit(10))
    good = F.pmod("id", F.lit(2)) == 0
    secret = (
        F.when((kind == 0) & (F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(3)) == 0), block).when(kind == 0, F.concat(F.lit("AKIA"), F.upper(F.substring(h("a"), 1, 16)))).when(kind == 1, F.concat(F.lit("ghp_"), letters("b", 36)))
        .when(kind.isin(2, 3), F.substring(h("c"), 1, 40)).when(kind == 4, F.substring(h("d"), 1, 32)).when(kind == 5, letters("e", 40)).when(kind == 6, F.substring(h("f"), 1, 12))
        .when(kind == 7, F.substring(h("f"), 1, 16)).when(kind == 8, F.concat(letters("g", 7), F.lit("!"), digits("g", 3), F.lit("_"), letters("i", 4))).otherwise(letters("h", 16))
    )
    harmless = (
        F.when(kind == 0, pickone("p", ["changeme", "your_api_key_here", "xxxxxxxxxxxx", "${SECRET_TOKEN}", "password123", "insert-token-here", "example_secret", "<password>", "undefined", "1234567890"]))
        .when(kind.isin(1, 2), F.substring(h("n"), 1, 40)).when(kind == 3, F.substring(h("o"), 1, 32)).when(kind == 4, F.concat_ws("_", word("q"), word("r"), word("s"), word("t"), digits("t", 2)))
        .when(kind == 5, F.concat_ws(".", word("u"), word("v"), word("w"))).when(kind == 6, F.concat(word("x"), F.lit("-"), word("y"))).when(kind == 7, F.concat_ws("/", word("z"), word("0"), word("1")))
        .when(kind == 8, F.concat(word("2"), F.initcap(word("3")), F.initcap(word("4")), F.initcap(word("5")), digits("5", 2))).otherwise(F.regexp_replace(h("6"), "[a-f]", "0"))
    )
    # Keys of a known form need no name beside them.
    secret_before = F.when((kind <= 1) & (F.pmod(F.xxhash64(F.lit("bare"), "id"), F.lit(4)) > 0), F.concat(text("7"), F.lit(" "), pickone("8'", ["key ", "use ", "the ", "with ", ""]))).otherwise(F.concat(text("7"), F.lit(" "), pickone("8", ["token = \"", "password=", "api_key: ", "secret: \"", "access_key=", "pwd = '", "credential: ", "auth token: "])))
    harmless_before = F.when(kind.isin(1, 2, 3, 9), F.concat(text("9"), F.lit(" "), pickone("A", ["commit ", "sha256: ", "checksum ", "etag = ", "digest: ", "example token ", "build ", "revision: ", "test hash = "]))).otherwise(
        F.concat(text("B"), F.lit(" "), pickone("C", ["token = ", "password: ", "secret = ", "api_key=", "name: ", "key = ", "for ", "the "]))
    )
    return made.select(
        F.when(F.pmod("id", F.lit(4)) == 1, pickone("D", ["tests/fixtures/a.py", "docs/example.md", "src/app.py", "spec/b.rb"])).otherwise(pickone("E", ["src/app.py", "src0", "config/prod.yml", "deploy.sh", "lib/main.go", "src7"])).alias("path"),
        F.when(good, secret_before).otherwise(harmless_before).alias("before"),
        F.when(good, secret).otherwise(harmless).alias("secret"), F.concat(pickone("F", ["\"", " ", "\n", "", " and"]), F.lit(" "), text("G")).alias("after"), good.cast("double").alias("label"),
    )


@dataclass
class Forest:
    """The trees as nested tuples (feature, threshold, left, right) or the probability of a leaf, and the dictionary's pattern."""

    trees: list
    dictionary: str

    def probability(self, v: Column) -> Column:
        value = {}

        def node(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(t)
            feature, threshold, left, right = t
            if feature not in value:
                value[feature] = F.get(v, F.lit(feature))
            return F.when(value[feature] <= threshold, node(left)).otherwise(node(right))

        total = node(self.trees[0])
        for t in self.trees[1:]:
            total = total + node(t)
        return total / len(self.trees)


def _trees(spark: SparkSession, model: RandomForestClassificationModel) -> list:
    """The model's trees, read from its saved form."""
    path = f"{shared_folder(spark)}/forest-{model.uid}"
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").collect()
    delete(spark, path)
    nodes = {(r["treeID"], r["nodeData"]["id"]): r["nodeData"] for r in rows}

    def build(tree: int, i: int):
        n = nodes[tree, i]
        if n["leftChild"] < 0:
            stats = n["impurityStats"]
            return float(stats[1] / sum(stats))
        return (n["split"]["featureIndex"], float(n["split"]["leftCategoriesOrThreshold"][0]), build(tree, n["leftChild"]), build(tree, n["rightChild"]))

    return [build(t, 0) for t in sorted({t for t, _ in nodes})]


def pattern_of(words: list[str]) -> str:
    """The longest word first, so that a match covers as much as it can."""
    return "|".join(sorted({w for w in [*words, *WORDS] if len(w) >= LETTERS}, key=lambda w: (-len(w), w)))


def fit(labelled: DataFrame, words: list[str] = [], trees: int = 24, depth: int = 7, seed: int = 7) -> Forest:  # noqa: B006
    """Trains on labelled findings (path, before, secret, after, label), with the words of the corpus in the dictionary."""
    dictionary = pattern_of(words)
    clean = labelled.where("secret is not null and label is not null").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("path", "before", "secret", "after")], F.col("label").cast("double").alias("label"))
    rows = clean.select(array_to_vector(features(F.col("path"), F.col("before"), F.col("secret"), F.col("after"), dictionary)).alias("features"), "label")
    model = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(rows)
    return Forest(_trees(labelled.sparkSession, model), dictionary)


def trained(df: DataFrame, labelled: DataFrame | None, text_col: str) -> Forest:
    """A forest for a corpus: its words, and the labelled findings or, without any, those made by rule."""
    words = top_words(df, text_col)
    return fit(labelled if labelled is not None else labelled_findings(df.sparkSession), words)


def pieces(text: Column) -> Column:
    """array<string>: gap, match, gap, match, ..., gap; one pass of the pattern."""
    plain = F.translate(text, _MARK, "\ufffe")
    return F.split(F.regexp_replace(plain, PATTERN, f"{_MARK}$0{_MARK}"), _MARK, -1)


def _hits(p: Column, at: Column | None) -> Column:
    """array<struct<start, secret, before, after>> of the matches among the pieces, which begin at ``at`` (start 0 without it)."""

    def hit(k: Column) -> Column:
        found = F.get(p, k)
        name = F.regexp_extract(found, f"^{ASSIGNED}", 0)
        return F.struct(
            (F.lit(0).cast("bigint") if at is None else F.get(at, k) + F.length(name)).alias("start"), F.substr(found, F.length(name) + 1).alias("secret"),
            F.concat(F.substring(F.get(p, k - 1), -60, 60), name).alias("before"), F.substring(F.get(p, k + 1), 1, 40).alias("after"),
        )

    return F.when(F.size(p) > 2, F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), hit)).otherwise(F.array().cast("array<struct<start:bigint,secret:string,before:string,after:string>>"))


def _located(text: Column) -> Column:
    return let(pieces(text), lambda p: let(sums_before(F.transform(p, F.length)), lambda at: _hits(p, at)))


def candidates(df: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """(id, path, start, secret, before, after) of all matches; one small row each."""
    rows = pick(df, **({"id": id_col, "text": text_col} | ({"path": path_col} if path_col else {})))
    path = F.coalesce(F.col("path").cast("string"), F.lit("")) if path_col else F.lit("")
    return rows.select("id", path.alias("path"), F.explode(_located(F.col("text"))).alias("x")).select("id", "path", "x.*")


def scan(df: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5, forest: Forest | None = None) -> DataFrame:
    """One row per candidate: id_col, start, length, kind, secret, probability, is_secret. ``forest``: one that was trained before."""
    forest = forest or trained(df, labelled, text_col)
    found = candidates(df, id_col, text_col, path_col)
    vector = features(F.col("path"), F.col("before"), F.col("secret"), F.col("after"), forest.dictionary)
    scored = found.withColumn("x", let(vector, lambda v: F.struct(F.round(forest.probability(v), 6).alias("p"), (F.get(v, F.lit(DENSE.index("known"))) == 1).alias("known"), (F.get(v, F.lit(DENSE.index("named"))) == 1).alias("named"))))
    kind = F.when(F.col("x.known"), "key format").when(F.col("x.named"), "assigned").otherwise("random run")
    return scored.select(F.col("id").alias(id_col), F.col("start").cast("long").alias("start"), F.length("secret").alias("length"), kind.alias("kind"), "secret", F.col("x.p").alias("probability"), (F.col("x.p") >= threshold).alias("is_secret"))


MARK = "[SECRET]"


def redact(df: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5, forest: Forest | None = None) -> DataFrame:
    """df, all columns, with MARK in the place of each secret: by its offsets, so the same characters elsewhere stay."""
    forest = forest or trained(df, labelled, text_col)
    rows, text, names = numbered_columns(df, text_col)
    path = F.coalesce(F.col(f"c{names.index(path_col)}").cast("string"), F.lit("")) if path_col else F.lit("")

    def cleaned(p: Column) -> Column:
        def verdict(x: Column) -> Column:
            sure = let(features(path, x["before"], x["secret"], x["after"], forest.dictionary), forest.probability)
            return F.when(F.round(sure, 6) >= threshold, F.length(x["secret"])).otherwise(0)

        # The characters that go at the end of each match; a name that the value is assigned to stays before the mark.
        def put(gone: Column) -> Column:
            return F.array_join(F.transform(p, lambda x, i: F.when(i % 2 == 0, x).otherwise(let(F.get(gone, F.floor(i / 2).cast("int")), lambda g: F.when(g > 0, F.concat(F.substr(x, F.lit(1), F.length(x) - g), F.lit(MARK))).otherwise(x)))), "")

        return F.when(F.size(p) > 2, let(F.transform(_hits(p, None), verdict), put)).otherwise(F.col(text))

    return rows.withColumn(text, let(pieces(F.col(text)), cleaned)).toDF(*names)
