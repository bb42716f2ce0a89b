"""Secrets: candidates by pattern, false positives removed by a random forest, with DataFrame functions alone.

A candidate is a run of letters, digits and _ + / . - of at least 12 characters with a letter and a digit, any value
of at least 4 characters that is assigned to a secret-like name, or quoted after one, the password of a URL with a
user, or the body of a private key block. The forest sees its length, its character transitions, how much of it dictionary words cover, what makes it look like
a path, and the words beside it. It is trained from labelled findings: `labelled_findings` writes out a stated
number of them, of known kinds of secrets and of what is often mistaken for one; a table of one's own findings
(before, candidate, after, label) serves as well.

Defined results: null and empty texts have no findings; whole texts are scanned, of any length; repeated rows
repeat their findings; null ids are kept; an empty table gives no rows; columns other than those asked for are
left out by find and kept by redact, which masks candidates found to be secrets, wherever they stand as candidates.
A finding carries its surroundings, never the text; places are sums over blocks of 256 pieces. at counts characters from 0, finding counts a document's candidates from 1.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import columns, store, table

RUN = "A-Za-z0-9_+/.-"
LONG = rf"(?<![{RUN}])(?=[A-Za-z_+/.-]*[0-9])(?=[0-9_+/.-]*[A-Za-z])[{RUN}]{{11,}}[A-Za-z0-9]"
NAME = r"(?i:token|secret|passw|passphrase|pwd|api.?key|access.?key|auth|credential|private|bearer|(?<![a-z])key)[A-Za-z0-9_-]{0,20}[\"'`]?"
#: After a name: a value in quotes, and one up to white space. The short lookbehinds spare the long one most places.
QUOTED = rf"(?<=[\"'`])(?<=[=:\s][\"'`])(?<={NAME}\s{{0,2}}[=:]{{0,2}}\s{{0,2}}[\"'`])[^\"'`\r\n]{{4,200}}(?=[\"'`])"
BARE = rf"(?<=[=:\s])(?<=[=:]\s{{0,2}})(?<={NAME}\s{{0,2}}[=:]{{1,2}}\s{{0,2}})[^\s\"'`<>=:][^\s\"'`<>]{{2,}}[^\s\"'`<>.,;:?)\]}}]"
#: Between a URL's user and host, and between the marks of a private key block.
USERINFO = r"(?<=:)(?<=://[^\s/:@]{0,60}:)[^\s/:@\"'`<>]{4,200}(?=@)"
BLOCK = r"(?<=-----)(?<=PRIVATE KEY-----)[A-Za-z0-9+/=\s:,.-]{16,20000}?(?=-----END)"
CANDIDATE = rf"(?:{USERINFO}|{BLOCK}|{QUOTED}|{BARE}|{LONG})"
#: What stands before a candidate, and it; at the end of a text what is left, and nothing.
PIECE = rf"([\s\S]*?)({CANDIDATE}|\z)"
#: Labelled findings that the forest is trained from.
FINDINGS = 6_000
NEAR = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|auth|credential|private|bearer|(^|[^a-z])key)"
FAR = r"(?i)(commit|sha-?\d|md5|checksum|digest|uuid|guid|version|release|hash|etag|mail|https?:|www)"
WORDS = r"(?i)(example|release|version|build|index|mail|html|docs|test|changeme|password|your|sample|file|image|http|www|com|org|net|tion|ing|ent|est|the|and|ch|er|en)"
PAIRS = r"(?i)(th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|ed|is|it|al|ar|st|to|nt|ou|ea|ha|ch|ei|qu|ie|ue|os|la)"
KNOWN = r"^(AKIA|ASIA|ghp_|gho_|sk_live_|xox[bp]-|AIza|glpat-|npm_|eyJ)"
INPUTS = ("n", "digits", "uppers", "runs", "distinct", "hex", "pairs", "covered", "slashes", "dots", "dashes", "at_sign", "assigned", "quoted", "near", "far", "known", "userinfo", "block")


def _inputs(df: DataFrame) -> DataFrame:
    """df (before, candidate, after) with the forest's inputs."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")

    def share(pattern: str):
        return (n - F.length(F.regexp_replace(c, pattern, ""))) / n

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Z]", "U"), "[a-z]", "l"), "[0-9]", "d")
    flag = lambda x: x.cast("double")
    made = {
        "n": n, "digits": share("[0-9]"), "uppers": share("[A-Z]"), "runs": F.length(F.regexp_replace(kinds, r"(.)\1*", "$1")) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n, "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "pairs": share(PAIRS), "covered": share(WORDS),
        "slashes": share("/"), "dots": share("[.]"), "dashes": share("[-_]"), "at_sign": flag(F.col("before").rlike(r"(@|://|/)$")),
        "assigned": flag(F.col("before").rlike(r"""[=:]\s{0,2}["'`]?$""")), "quoted": flag(F.col("before").rlike(r"""["'`]$""") & F.col("after").rlike(r"""^["'`]""")),
        "near": flag(F.col("before").rlike(NEAR)), "far": flag(F.col("before").rlike(FAR)), "known": flag(c.rlike(KNOWN)),
        "userinfo": flag(F.col("before").rlike(r"://[^\s/:@]*:$") & F.col("after").startswith("@")), "block": flag(F.col("before").endswith("PRIVATE KEY-----")),
    }
    return df.select("*", *[v.alias(f"_{k}") for k, v in made.items()])


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """before, candidate, after, label: findings made from hashes of a row number."""
    hexed = "sha2(concat('finding', id), 512)"
    mixed = f"replace(replace(base64(unhex({hexed})), '/', 'q'), '+', 'Z')"
    upper = f"translate(upper(substr({hexed}, 1, 60)), '01289', 'GKQZ7')"
    word = "element_at(array('then', 'ingot', 'vers', 'order', 'esten', 'tionen', 'lachen', 'queso'), CAST(id DIV 31 % 8 AS INT) + 1)"
    other = "element_at(array('horse', 'river', 'staple', 'winter', 'monkey', 'falke', 'sombra', 'jardin'), CAST(id DIV 251 % 8 AS INT) + 1)"
    kinds = [  # before, candidate, label
        ("'token = \"'", f"substr({hexed}, 1, 40)", 1), ("'password='", f"substr({hexed}, 1, 18)", 1), ("' '", f"concat('AKIA', substr({upper}, 1, 16))", 1),
        ("'api_key: \\''", f"substr({mixed}, 1, 32)", 1), ("'secret=\"'", f"substr({mixed}, 1, 24)", 1), ("'Bearer '", f"concat('eyJ', substr({mixed}, 1, 60), '.', substr({hexed}, 1, 40))", 1),
        ("'use '", f"concat('ghp_', substr({mixed}, 1, 36))", 1), ("'secret_key='", f"concat('sk_live_', substr({mixed}, 1, 24))", 1), ("'auth token: '", f"substr({hexed}, 5, 32)", 1),
        ("'commit '", f"substr({hexed}, 1, 40)", 0), ("'sha256: '", f"substr({hexed}, 1, 64)", 0), ("'md5 '", f"substr({hexed}, 1, 32)", 0),
        ("'id '", f"concat_ws('-', substr({hexed}, 1, 8), substr({hexed}, 9, 4), substr({hexed}, 13, 4), substr({hexed}, 17, 4), substr({hexed}, 21, 12))", 0),
        ("'jo@'", "concat('mail', id % 10, '.example.com')", 0), ("'https://host/'", f"concat('docs/v', id % 7, '/', {word}, '/index-', id % 90, '.html')", 0),
        ("'password='", "element_at(array('changeme123456', 'your_password_1', 'example_password1', 'test1234test1234'), CAST(id DIV 17 % 4 AS INT) + 1)", 0),
        ("'file '", "concat('release-20', 10 + id % 20, '.', 1 + id % 12, '-build', id % 9)", 0), ("' '", f"concat({word}, {word}, id % 100, {word})", 0), ("' '", f"substr({hexed}, 1, 40)", 0), ("'size '", f"concat(id % 5000, {word}, {word}, {word})", 0),
        ("'secret='", f"concat({word}, {other}, {word}, {other}, 'ing')", 1), ("'pwd='", f"concat({word}, id % 100, {other})", 1), ("'password = \"'", f"concat(substr({mixed}, 1, 7), '&', substr({mixed}, 9, 5), '!')", 1),
        ("'postgres://admin:'", f"substr({mixed}, 1, 14)", 1, "'@db.host/x'"), ("'ftp://jo:'", f"concat({word}, id % 100, {other})", 1, "'@files.example.com/'"),
        ("'https://user:'", "element_at(array('password', 'pass', 'changeme', 'xxxx'), CAST(id DIV 17 % 4 AS INT) + 1)", 0, "'@host/'"),
        ("'-----BEGIN RSA PRIVATE KEY-----'", f"concat('\\n', {mixed}, '\\n', {hexed}, '\\n')", 1, "'-----END RSA PRIVATE'"),
        ("'author: '", word, 0), ("'password: '", f"concat({word}, 'en')", 0), ("'key = \"'", f"concat({word}, ' ', {other})", 0), ("'token: '", word, 0),
    ]
    kinds = [(*x, "'\" '")[:4] for x in kinds]
    pick = lambda i: "CASE " + " ".join(f"WHEN id % {len(kinds)} = {k} THEN {x[i]}" for k, x in enumerate(kinds)) + " END"
    made = spark.range(n).selectExpr("id", f"concat({word}, ' ', {pick(0)}) AS before", f"{pick(1)} AS candidate", f"{pick(3)} AS after", f"CAST({pick(2)} AS DOUBLE) AS label")
    return made.select(*[F.when(F.expr("id DIV 20 % 6 = 0") & ~F.col("before").contains("PRIVATE"), F.upper(x)).otherwise(F.col(x)).alias(x) for x in ("before", "candidate", "after")], "label")


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest from findings (before, candidate, after, label)."""
    rows = VectorAssembler(inputCols=[f"_{k}" for k in INPUTS], outputCol="_x").transform(_inputs(findings)).select("_x", "label").coalesce(1)
    return RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=40, maxDepth=8, seed=8).fit(rows)


def _pieces(rows: DataFrame, text: str) -> DataFrame:
    """rows with _gaps and _found: a text is each gap and what was found behind it, one after the other; the last found is empty."""
    return rows.withColumn("_gaps", F.regexp_extract_all(text, F.lit(PIECE), F.lit(1))).withColumn("_found", F.regexp_extract_all(text, F.lit(PIECE), F.lit(2)))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each candidate of docs, whose texts aren't null: docs' other columns, finding, at, before, candidate, after."""
    others = [c for c in docs.columns if c != text]
    pieces = _pieces(docs, text).select(*others, "_gaps", "_found")
    pieces = pieces.withColumn("_n", F.expr("zip_with(_gaps, _found, (g, f) -> length(g) + length(f))"))
    pieces = pieces.withColumn("_sums", F.expr("transform(sequence(0, (size(_n) - 1) DIV 256), b -> aggregate(slice(_n, b * 256 + 1, 256), 0, (x, y) -> x + y))"))
    pieces = pieces.withColumn("_starts", F.expr("transform(_sums, (s, b) -> aggregate(slice(_sums, 1, b), 0, (x, y) -> x + y))"))
    # a candidate has 4 characters at least, so the 40 before it lie in its gap and the ten pieces before that
    pieces = pieces.withColumn("_ends", F.expr("zip_with(_gaps, _found, (g, f) -> right(concat(right(g, 40), f), 40))")).withColumn("_heads", F.expr("zip_with(_gaps, _found, (g, f) -> left(concat(left(g, 20), f), 20))"))
    each = """transform(filter(sequence(0, size(_found) - 1), i -> _found[i] <> ''), i -> struct(
        i + 1 AS finding, _starts[i DIV 256] + aggregate(slice(_n, i DIV 256 * 256 + 1, i % 256), 0, (x, y) -> x + y) + length(_gaps[i]) AS at,
        right(concat(array_join(slice(_ends, greatest(i - 10, 0) + 1, least(i, 10)), ''), right(_gaps[i], 40)), 40) AS before,
        _found[i] AS candidate, left(array_join(slice(_heads, i + 2, 5), ''), 20) AS after))"""
    return pieces.select(*others, F.explode(F.expr(each)).alias("_c")).select(*others, "_c.*")


def scored(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """found with score and is_secret."""
    rows = VectorAssembler(inputCols=[f"_{k}" for k in INPUTS], outputCol="_x").transform(_inputs(found))
    return model.setFeaturesCol("_x").transform(rows).withColumn("score", vector_to_array("probability")[1]).withColumn("is_secret", F.col("score") >= 0.5).select(*found.columns, "score", "is_secret")


def find(docs: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """doc_id, finding, at, n_chars, value_sha256, score, is_secret of every candidate in docs (doc_id, text)."""
    touched = store(columns(docs, "doc_id", "text").where(F.col("text").rlike(CANDIDATE)), "touched")  # apart, the patterns cost a third of what they do in one plan
    rows = scored(candidates(touched), model)
    return rows.select("doc_id", "finding", "at", F.length("candidate").alias("n_chars"), F.sha2("candidate", 256).alias("value_sha256"), "score", "is_secret")


def redact(docs: DataFrame, model: RandomForestClassificationModel, mask: str = "[SECRET]", text: str = "text") -> DataFrame:
    """docs with each secret in text replaced by mask. Rows without candidates pass as they are."""
    some = F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False))
    touched = store(docs.where(some).withColumn("_key", F.xxhash64(F.to_json(F.struct(*docs.columns)))).withColumn("_sha", F.sha2(F.col(text), 256)), "touched")
    rows = scored(candidates(touched.select("_key", "_sha", F.col(text).alias("_text")), "_text"), model)
    rows = store(rows.where("is_secret").groupBy("_key", "_sha").agg(F.collect_set("candidate").alias("_secrets")), "secrets")
    masked = F.expr(f"array_join(zip_with(_gaps, _found, (g, f) -> concat(g, IF(array_contains(_secrets, f), '{mask}', f))), '')")
    out = _pieces(touched.join(rows, ["_key", "_sha"]), text).withColumn(text, masked).select(*docs.columns)
    clean = touched.join(rows.select("_key", "_sha"), ["_key", "_sha"], "left_anti").select(*docs.columns)
    return docs.where(~some).union(clean).union(out)


def op8(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), train(labelled_findings(spark)))
