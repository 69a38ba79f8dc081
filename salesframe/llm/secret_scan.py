"""Secret scan: candidates by shape, false positives removed by a random forest.

Candidates are runs of at least ``SHORTEST`` letters, digits and ``+/_-`` that hold a digit, and, whatever
their length and characters, values assigned to a secret's name (up to white space, or the closing quote of the
same line, blanks included) and strings of a known key format. A forest decides which are secrets, from the
candidate's length, its character classes, how unusual its character transitions are in this corpus, how much of it
words of this corpus cover (words in at least ``WORD_DOCUMENTS`` documents), the document's path and the words
next to it.

It is trained on labelled findings: those given, or planted ones (``planted_findings``), texts of known content in
which real keys, pass phrases and key blocks are secrets, and placeholders, prose after a colon, settings,
references, identifiers and numbers are not. The same names, signs and quotes stand before both kinds, so
no feature states the label. All steps, training included, are DataFrame and ML functions of Spark.

Only a bounded sample of findings is learned from (``sample``); all candidates of all whole texts are scored, and words
and transitions are counted over all documents.

Defined cases: a null text has no candidates; a null path has none of the marks of a path; null
labels and null ids teach nothing; if findings of one kind only are known, every candidate gets their
smoothed share as score; repeated rows are scanned each on their own; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
import random
from string import ascii_letters, ascii_lowercase

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .common import text_or_empty

SHORTEST = 12
SAMPLE = 20000
TREES, DEPTH, SEED = 40, 10, 7
THRESHOLD = 0.5

CANDIDATE = rf"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{{{SHORTEST},}}={{0,2}}"

# Words a name or text near a secret holds, marks of placeholders and of example paths, and
# formats of known keys.
SECRET_WORDS = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer"
EXAMPLE_WORDS = "example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test|mock|fixture|docs?/"
KNOWN = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9\-]{10,}|sk_live_[A-Za-z0-9]{16,}"
KNOWN_START = "AKIA|gh[pousr]_|xox|sk_live_"
CONFIG_PATH = r"(?i)(\.env|\.pem|\.key|\.ya?ml|\.json|\.ini|\.cfg|\.conf|\.properties)$"
REFERENCE = r"^[$<{%\[(@]|[({\[]\S*[)}\]]|^\*+$|^(self|this|os|env|config|settings)[.\[]"

# a name that holds a secret word, of any length; what stands between it and its value; the value, quoted or not
_NAME = rf"(?:{SECRET_WORDS})[^=:\s\"']*[\"'\]]{{0,2}}"
_VALUE = r"(?:\"([^\"]+)|'([^']+)|([^\"'=:][^\"']*))"
IN_WORD = rf"(?i){_NAME}[=:]+{_VALUE}"
AFTER_SIGN = rf"^{_VALUE}"
AFTER_NAME = rf"^[=:]+{_VALUE}"
KNOWN_INSIDE = f"(?<![A-Za-z0-9])({KNOWN})(?![A-Za-z0-9])"
#: Quoted values with blanks, and bodies of private keys, of a whole text.
PHRASES = [rf"(?i){_NAME}[ \t]?[=:]+[ \t]?{q}([^{q}\n]*[ \t][^{q}\n]*){q}" for q in "\"'"]
KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----([^-]*)"

#: Documents from which on a run of letters counts as a word.
WORD_DOCUMENTS = 5
#: Words that planted findings are written with.
PLANTED_WORDS = 2000

FEATURES = ["length", "lower", "upper", "digit", "other", "turns", "class_turns", "distinct", "hexadecimal", "known", "reference",
            "blanks", "covered", "surprise", "secret_near", "assigned", "quoted", "example_near", "example_in", "example_path",
            "config_path", "depth", "in_block"]


def candidates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """Every candidate of every whole text: ``id``, ``word`` and ``nth`` place, ``candidate``, ``left``, ``right``, ``path``
    and ``in_block``, whether it belongs to a private key.

    ``left`` are the two words before and what stands before the candidate in its own word;
    ``right`` is what follows it and the next word.
    """
    body = text_or_empty(text)
    words = F.split(body, r"[\x20\x09-\x0D]+")
    found = lambda pattern: F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    rows = docs.select(F.col(id_column).alias("id"), F.col(path).cast("string").alias("path"), words.alias("words"),
                       F.when(body.contains('"') | body.contains("'"), F.concat(*[found(p) for p in PHRASES])).alias("phrases"),
                       F.when(body.contains("PRIVATE KEY-----"), F.array_join(found(KEY_BLOCK), " ")).alias("block"))
    near = F.expr(f"""filter(transform(words, (w, i) -> named_struct('word', i, 'body', w,
        'before', concat_ws(' ', IF(i > 1, words[i - 2], NULL), IF(i > 0, words[i - 1], NULL)),
        'after', coalesce(get(words, i + 1), ''))), x -> (length(x.body) >= {SHORTEST} AND x.body RLIKE '[0-9]') OR x.body RLIKE '[=:]|{KNOWN_START}'
            OR x.before RLIKE '[=:]$')""")
    rows = rows.select("id", "path", "phrases", "block", F.explode(near).alias("x")).select("id", "path", "phrases", "block", "x.*")

    def values(pattern: str) -> Column:
        every = [F.regexp_extract_all("body", F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
        # punctuation behind an unquoted value, closing brackets only where none is opened in it
        return F.concat(*every[:2], F.transform(every[2], lambda v: F.when(
            v.rlike(r"[(\[{<]"), F.regexp_replace(v, "[.,;:]+$", "")).otherwise(F.regexp_replace(v, r"[.,;:)\]}>]+$", ""))))

    sign, name = F.col("before").rlike(rf"(?i){_NAME} ?[=:]+$"), F.col("before").rlike(rf"(?i){_NAME}$")
    none = F.array().cast("array<string>")
    runs = F.regexp_extract_all("body", F.lit(CANDIDATE), F.lit(0))
    assigned = F.filter(F.concat(
        F.when(F.col("body").rlike("[=:]"), values(IN_WORD)).otherwise(none), F.when(sign, values(AFTER_SIGN)).otherwise(none),
        F.when(name & F.col("body").rlike("^[=:]"), values(AFTER_NAME)).otherwise(none)), lambda v: v != "")
    # an opened quote goes on to its end in the same line
    whole = F.transform(assigned, lambda v: F.coalesce(
        F.get(F.filter("phrases", lambda p: p.startswith(F.concat(v, F.lit(" ")))), F.lit(0)), v))
    known = F.when(F.col("body").rlike(KNOWN_START), F.regexp_extract_all("body", F.lit(KNOWN_INSIDE), F.lit(1))).otherwise(none)
    more = F.array_distinct(F.concat(whole, known))
    rows = rows.select("*", F.posexplode(F.concat(runs, F.array_except(more, runs))).alias("nth", "candidate"))
    # a short value may also occur in its own name: it stands after the sign; of a phrase the first word is in place
    own = F.substring_index("candidate", " ", 1)
    after = [F.instr(F.col("body"), F.concat(F.lit(sign), own)) for sign in ('="', "='", "=", ':"', ":'", ":")]
    cut = F.coalesce(*[F.when(at > 0, at + len(sign)) for at, sign in zip(after, ('="', "='", "=", ':"', ":'", ":"))],
                     F.instr(F.col("body"), own))
    return rows.select(
        "id", "path", "word", "nth", "candidate",
        F.concat("before", F.lit(" "), F.substring("body", F.lit(1), cut - 1)).alias("left"),
        F.concat(F.substring("body", cut + F.length(own), F.length("body")), F.lit(" "), "after").alias("right"),
        F.coalesce(F.col("block").contains(F.col("candidate")), F.lit(False)).alias("in_block"))


# --- words and transitions of the corpus -------------------------------------

def corpus_words(docs: DataFrame, text: str = "text", least: int = WORD_DOCUMENTS) -> DataFrame:
    """``piece`` and ``docs`` of the runs of letters that occur in at least ``least`` documents, written once."""
    each = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit("[a-z]{3,}"), F.lit(0)))).alias("piece"))
    return settle(each.groupBy("piece").agg(F.count("*").alias("docs")).where(F.col("docs") >= least), "words")


def transitions(words: DataFrame) -> dict[str, float]:
    """For each pair of letters a to z, minus the logarithm of how often the second follows the first in words; 676 numbers."""
    pairs = words.select("docs", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("piece") - 1), lambda i: F.substring("piece", i, F.lit(2)))).alias("pair"))
    counts = {r.pair: r.n for r in pairs.groupBy("pair").agg(F.sum("docs").alias("n")).collect()}
    out = {}
    for a in ascii_lowercase:
        total = sum(counts.get(a + b, 0) for b in ascii_lowercase) + 26
        out |= {a + b: math.log(total / (counts.get(a + b, 0) + 1)) for b in ascii_lowercase}
    return out


def _covered(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` with ``covered``, the share of each candidate's characters that are words of the corpus."""
    rows = settle(rows.withColumn("_row", F.monotonically_increasing_id()), "candidates")
    plain = F.lower(F.regexp_replace("candidate", "(?<=[a-z])(?=[A-Z])", " "))
    pieces = rows.select("_row", F.explode(F.regexp_extract_all(plain, F.lit("[a-z]{3,}"), F.lit(0))).alias("piece"))
    found = pieces.join(words.select("piece"), "piece").groupBy("_row").agg(F.sum(F.length("piece")).alias("_in_words"))
    return rows.join(found, "_row", "left").withColumn(
        "covered", F.coalesce("_in_words", F.lit(0)) / F.length("candidate")).drop("_row", "_in_words")


def with_features(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` of ``candidates`` with the columns named in ``FEATURES``, all doubles; ``words`` as in ``corpus_words``."""
    c, size = F.col("candidate"), F.length("candidate").cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / size

    def has(column: str, pattern: str) -> Column:
        return F.coalesce(F.col(column).rlike(pattern), F.lit(False)).cast("double")

    odds = F.create_map(*[F.lit(x) for pair in transitions(words).items() for x in pair])
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(F.lower(c), i, F.lit(2))),
                     lambda p: p.rlike("^[a-z]{2}$"))
    found = {
        "length": size, "lower": share("[a-z]"), "upper": share("[A-Z]"), "digit": share("[0-9]"),
        "other": share("[^A-Za-z0-9]"),
        "turns": share("(?<=[a-zA-Z])(?=[0-9])|(?<=[0-9])(?=[a-zA-Z])"),
        "class_turns": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
        "hexadecimal": has("candidate", "^[0-9a-fA-F]+$"), "known": has("candidate", f"^({KNOWN})$"),
        "reference": has("candidate", REFERENCE), "blanks": share(" "), "covered": F.col("covered"),
        "surprise": F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.element_at(odds, p)) / F.size(pairs))
        .otherwise(0.0),
        "secret_near": has("left", f"(?i){SECRET_WORDS}"), "assigned": has("left", "[=:][\"' ]*$"),
        "quoted": has("left", "[\"']$"), "example_near": F.greatest(
            has("left", f"(?i){EXAMPLE_WORDS}"), has("right", f"(?i){EXAMPLE_WORDS}")),
        "example_in": has("candidate", f"(?i){EXAMPLE_WORDS}"),
        "example_path": has("path", f"(?i){EXAMPLE_WORDS}"), "config_path": has("path", CONFIG_PATH),
        "depth": F.coalesce(F.regexp_count("path", F.lit("/")), F.lit(0)).cast("double"),
        "in_block": F.col("in_block").cast("double"),
    }
    return _covered(rows, words).withColumns({k: found[k] for k in FEATURES})


# --- labelled findings -------------------------------------------------------

def planted_findings(words: list[str], n: int = 6000, seed: int = SEED) -> list[tuple[int, str, str | None, str, int]]:
    """Texts of known content: (id, text, path, value, label); the value of half of them is a secret."""
    rng = random.Random(seed)
    words = words or ["the", "and", "for", "with", "that", "this", "from", "are"]
    pick, some = rng.choice, lambda chars, low, high: "".join(rng.choices(chars, k=rng.randint(low, high)))
    word = lambda: pick(words)
    prose = lambda k: " ".join(word() for _ in range(k))
    hexa, mixed, digits = "0123456789abcdef", ascii_letters + "0123456789", "0123456789"
    names = ["password", "passwd", "db_password", "DB_PASSWORD_PROD", "secret", "client_secret", "token", "auth_token", "api_key",
             "API-KEY", "aws_secret_access_key", "private_key", "credential", "bearer_token", "admin.password"]

    def assigned(value: str) -> str:
        name, sign, quote = pick(names), pick(["=", " = ", ": ", ":", " : "]), pick(["", '"', "'"])
        if " " in value:
            quote = pick(['"', "'"])
        return f"{name}{sign}{quote}{value}{quote}"

    def real() -> tuple[str, str]:
        kind = rng.randrange(8)
        if kind == 0:
            value = some(hexa, 16, 64)
        elif kind == 1:
            value = some(mixed, 10, 44)
        elif kind == 2:
            value = some(mixed + "!@#%&*+-_", 8, 20)
        elif kind == 3:
            value = pick([str.capitalize, str.upper, str.lower])(word()) + some(digits, 2, 5) + pick("!?#*$&")
        elif kind == 4:
            value = " ".join(word() for _ in range(rng.randint(3, 5)))
        elif kind == 5:
            value = some(mixed + "+/", 40, 88)
        elif kind == 6:
            value = pick(["AKIA" + some(ascii_letters.upper()[:26] + digits, 16, 16), "ghp_" + some(mixed, 36, 36),
                          "xoxb-" + some(digits, 10, 12) + "-" + some(mixed, 24, 24), "sk_live_" + some(mixed, 24, 24)])
            return value, pick([value, assigned(value), f"key {value} {word()}"])
        else:
            lines = [some(mixed + "+/", 64, 64) for _ in range(3)]
            return lines[rng.randrange(3)], "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(lines) + "\n-----END RSA PRIVATE KEY-----"
        return value, assigned(value)

    def harmless() -> tuple[str, str]:
        kind = rng.randrange(9)
        if kind == 0:
            value = pick(["changeme", "change-me", "your_password_here", "your-api-key", "xxxxxxxx", "placeholder", "example", "dummy",
                          "sample_token", "test", "mock-secret", "redacted", "todo", "secret", "password"]) + pick(["", some(digits, 1, 6)])
        elif kind == 1:
            value = word()
        elif kind == 2:
            value = pick(["unlimited", "true", "false", "none", "null", "required", "optional", "enabled", some(digits, 1, 4),
                          some(digits, 1, 3) + pick(["s", "ms", "h", "MB"])])
            return value, pick(["token_limit", "password_min_length", "auth_timeout", "secret_rotation", "token.ttl"]) + pick(["=", " = ", ": "]) + value
        elif kind == 3:
            value = pick(["${DB_PASSWORD}", "<password>", "{{ secret }}", "os.environ['TOKEN']", "getPassword()", "self.token", "*****",
                          "$SECRET", "%PASSWORD%", "config.secret"])
            return value.split()[0], pick(names) + pick(["=", " = ", ": "]) + value
        elif kind == 4:
            value = f"{word()}{some(digits, 3, 6)}-{word()}-{word()}-{some(digits, 1, 3)}"
            return value, value
        elif kind == 5:
            value = pick([some(digits, 12, 16), f"20{some(digits, 2, 2)}-10-11T12:33:{some(digits, 2, 2)}", "-".join(
                some(hexa, k, k) for k in (8, 4, 4, 4, 12)), f"{word()}_20{some(digits, 2, 2)}_{word()}_v{some(digits, 1, 2)}.pdf"])
            return value, pick(["id ", "order ", "file ", "ref: "]) + value
        elif kind == 6:
            value = some(hexa, 40, 40)
            return value, pick(["commit ", "sha1 ", "checksum ", "etag: "]) + value
        elif kind == 7:
            value = f"https://{word()}.example.com/{word()}/{some(digits, 4, 9)}?{word()}={some(hexa, 6, 12)}"
            return value, value
        else:
            value = f"{word()}-{word()}{some(digits, 1, 4)}/{word()}_{word()}"
            return value, value
        return value, assigned(value)

    rows = []
    for i in range(n):
        value, body = real() if i % 2 else harmless()
        path = pick([None, "src0", "src1", "conf/app.env", "deploy/values.yaml", "src/main.py", "docs/guide.md", "web"])
        rows.append((i, f"{prose(rng.randint(2, 8))} {body} {prose(rng.randint(2, 8))}", path, value, i % 2))
    return rows


def planted(spark: SparkSession, words: DataFrame, n: int = 6000, seed: int = SEED) -> DataFrame:
    """Candidates of planted texts with features and ``label``: the planted values, and whatever else harmless texts hold."""
    known = [r.piece for r in words.orderBy(F.xxhash64("piece"), "piece").limit(PLANTED_WORDS).collect()]
    rows = spark.createDataFrame(planted_findings(known, n, seed), "doc_id long, text string, source string, value string, label int")
    found = with_features(candidates(rows), words)
    truth = rows.select(F.col("doc_id").alias("id"), "value", "label")
    same = F.col("candidate") == F.col("value")
    return found.join(truth, "id").withColumn("label", F.when(same | (F.col("label") == 0), F.col("label"))).drop("value")


def train(findings: DataFrame, sample: int = SAMPLE):
    """A forest from ``findings`` (features and ``label``), or the smoothed share of secrets among them."""
    spot = F.xxhash64("id", "word", "nth", "candidate")
    known = findings.where("label IS NOT NULL AND id IS NOT NULL")
    total, secrets = known.agg(F.count("*"), F.sum("label")).first()
    if not secrets or secrets == total:
        return (float(secrets or 0) + 1) / (total + 2)
    # half of the sample for each kind, by hash; a generous share first, then the exact number
    parts = []
    for label, n in ((1, secrets), (0, total - secrets)):
        some = known.where(F.col("label") == label).withColumn("spot", spot)
        some = some.where(F.pmod("spot", F.lit(1 << 30)) / (1 << 30) * n < sample + 100)
        parts.append(some.orderBy("spot", "id").limit(sample // 2))
    rows = parts[0].unionByName(parts[1]).select(*FEATURES, F.col("label").cast("double").alias("label"), "spot")
    rows = rows.coalesce(1).sortWithinPartitions("spot")  # at most ``sample`` rows: the same forest every time
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows)


def score(rows: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """``rows`` of ``with_features`` with ``score`` and ``secret``."""
    if isinstance(model, float):
        scored = rows.withColumn("score", F.lit(model))
    else:
        scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    kept = [c for c in rows.columns if c not in FEATURES]
    return scored.select(*kept, "score", (F.col("score") >= threshold).alias("secret"))


def secret_scan(docs: DataFrame, findings: DataFrame | None = None, id_column: str = "doc_id", text: str = "text",
                path: str = "source", learn_from: Column | None = None) -> DataFrame:
    """All candidates of ``docs`` with ``score`` and ``secret``.

    ``findings`` (``id``, ``candidate``, ``label``) are labelled findings, of which those are learned from for which
    ``learn_from`` (a condition on ``id``) holds; without them the forest learns from planted ones.
    """
    words = corpus_words(docs, text)
    rows = settle(with_features(candidates(docs, id_column, text, path), words), "features")
    if findings is None:
        labelled = planted(docs.sparkSession, words)
    else:
        known = findings.groupBy("id", "candidate").agg(F.max(F.col("label").cast("int")).alias("label"))
        labelled = rows.join(known, ["id", "candidate"])
        if learn_from is not None:
            labelled = labelled.where(learn_from)
    return score(rows, train(settle(labelled, "labelled"))).drop("in_block").withColumnRenamed("id", id_column)
