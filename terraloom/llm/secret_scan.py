"""Secret scanning with a random forest against false positives (operator 7, DataFrame functions only).

Generators, in one pattern: the value assigned to a credential name, whatever its characters, from 6 on; the password in
the address of a URL; a value with a digit that a sentence gives ("the password is ...") or that follows a client's -p; and runs of 16 or
more key characters that hold a digit, with dotted runs that follow and a padding of "=" at their end.
Splitting a text at its candidates gives the context on both sides, so every step stays within the row: no candidate
is shuffled.

Features of a candidate: length; character transitions (runs of character kinds for each character); shares of digits,
capitals and marks; distinct characters for each character; share of letters in words of the corpus dictionary (all
letter runs in at least one of `RARE` documents, two at least; corpora of any size have about as many); depth and test words
of the path; and, from the words around, a credential name, its assignment right before, any assignment, a quote, an address, words of examples,
and words of digests, versions and orders.

The forest (Spark ML) is fitted on labelled findings: those given, or else planted ones, which are secrets or not by
construction (random values of several alphabets where secrets stand, against digests, ids, numbers, placeholders,
prose and names of things where they look alike), beside findings of the corpus with evidence that is no feature: the
prefix of a known issuer makes a secret, a card's check digit makes none; at most `MOST_LABELLED` of each, in the order of a
hash. Its trees become one CASE expression for scoring.

Defined cases: null and empty texts have no candidates; a null path counts as none; repeated rows are scanned
one by one; a very long text is one row, its offsets summed in blocks of `BLOCK` candidates; ties among labelled findings
of equal hash, and at the threshold (which counts as a secret), change no other row; an empty table gives an empty
result; extra columns of any name pass through `redact` and are not read. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import random
import re
import string

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import bounded_sample, cut, stage, table

_NAME = r"(?:secret|token|passw(?:or[dt]|d)|passphrase|passcode|pass(?![A-Za-z])|pwd|(?<![A-Za-z])pw(?![A-Za-z])|api.?key|access.?key|private.?key|credential|bearer|auth)"
_VALUE = r"[^\s\"'`<>,;]"
_NAMED = rf"(?=[A-CPSTa-cpst])(?i:{_NAME}[\w-]{{0,32}}+)"
_ASSIGN = r"[\"'`]?[\x20\t]{0,4}(?:=>|:=|[:=])[\x20\t]{0,4}(?i:Bearer[\x20])?[\"'`]?"
_GIVEN = _NAMED + _ASSIGN
_ADDRESS = r"://[^\s/@:\"'<>]{1,64}:"
#: A credential that a sentence names, and the password that follows a database client's -p; both hold a digit.
_IS = rf"\x20(?i:is):?\x20[\"'`]?(?={_VALUE}{{0,128}}[0-9])"
_SAID = _NAMED + _IS
_CLIENT = rf"-p(?<![\w-]-p)(?=[^\s\"'`<>,;=:/]{{0,64}}[0-9])"
# The name of a credential is tried once for both of its forms, and only where a letter may begin one.
CANDIDATE = (
    rf"{_NAMED}(?:{_ASSIGN}{_VALUE}{{6,}}|{_IS}{_VALUE}{{5,}}[^\s\"'`<>,;.])|{_ADDRESS}[^\s/@\"'<>]{{3,64}}@|{_CLIENT}[^\s\"'`<>,;=:/]{{6,}}"
    r"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}(?:\.[A-Za-z0-9_-]{16,}){0,4}={0,2}"
)
#: What of a match stands before the value.
LEAD = rf"^(?:{_GIVEN}(?={_VALUE}{{6}})|{_SAID}|{_ADDRESS}|-p(?=[^\s\"'`<>,;=:/]{{6}}))"
CREDENTIAL = rf"(?i){_NAME}|\bkey\b|(?<![\w-])-p$"
ISSUED = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35})$"
RARE = 100
MOST_LABELLED = 2000
PLANTED = 60
CONTEXT = 64
BLOCK = 256
FEATURES = ["length", "transitions", "digits", "capitals", "marks", "distinct", "dictionary", "path_depth", "path_test", "credential", "given", "assigned", "quoted", "address", "example", "counted"]


def dictionary(docs: DataFrame, text_col: str = "text", rare: int = RARE) -> list[str]:
    """The letter runs (3 or more letters) of at least one in `rare` documents and of two at least.

    Documents hold at most `rare` times their mean number of distinct runs of these, whatever the number of documents; the corpora tried have some four thousand.
    """
    runs = F.array_distinct(F.regexp_extract_all(F.lower(F.col(f"`{text_col}`")), F.lit(r"[a-z]{3,}"), 0))
    least = max(2, docs.count() / rare)
    counts = docs.select(F.explode(runs).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return sorted(r.w for r in counts.where(F.col("n") >= least).select("w").collect())


def _features(c: Column, known: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """known: how many letters of the candidate stand in words of the dictionary."""
    n = F.length(c).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(c, pattern, "")) / n
    all_letters = F.length(F.regexp_replace(c, r"[^A-Za-z]", ""))
    one = lambda x: F.when(x, 1.0).otherwise(0.0)
    path = F.coalesce(path, F.lit(""))
    near = F.substring(before, -32, 32)
    return {
        "length": n,
        "transitions": F.regexp_count(c, F.lit(r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) / n,
        "digits": share(r"[^0-9]"),
        "capitals": share(r"[^A-Z]"),
        "marks": share(r"[A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "dictionary": F.when(all_letters > 0, known / all_letters).otherwise(0.0),
        "path_depth": (F.length(path) - F.length(F.regexp_replace(path, "/", ""))).cast("double"),
        "path_test": one(path.rlike(r"(?i)test|example|fixture|sample|mock")),
        "credential": one(before.rlike(CREDENTIAL)),
        "given": one(before.rlike(rf"(?:{_GIVEN}|(?i:{_NAME}[\w-]{{0,32}}+\x20is:?\x20[\"'`]?)|(?<![\w-])-p|://[^\s/@]*:)$")),
        "assigned": one(before.rlike(r"(?:(?:=|:|=>)[\x20\t]*(?:Bearer[\x20])?[\"'`]?|(?<![\w-])-p)$")),
        "quoted": one(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")),
        "address": one(before.rlike(r"(?:://|www\.)[^\x20\t\n]*$") & ~(before.rlike(r"://[^\x20/@]*:$") & after.startswith("@"))),
        "example": one(F.concat(near, c).rlike(r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|<|\$\{")),
        "counted": one(near.rlike(r"(?i)\b(?:sha-?[0-9]*|md5|commit|checksum|digest|hash|uuid|guid|isbn|order|invoice|version|rev|revision|phone|card|id|no|base64)\b[^A-Za-z0-9]{0,3}$")),
    }


def _starts(gaps: Column, values: Column) -> Column:
    """The offset of every value: sums of lengths within blocks of `BLOCK` values, then over blocks, so that no array grows with the text."""
    steps = F.transform(values, lambda v, i: F.struct(F.length(F.get(gaps, i)).alias("g"), F.length(v).alias("v")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, BLOCK))
    none = F.array().cast("array<int>")
    run = lambda xs, size, ahead: F.aggregate(xs, F.struct(F.lit(0).alias("at"), none.alias("starts")), lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.array_append(acc["starts"], acc["at"] + ahead(x)).alias("starts")))
    inner = F.transform(blocks, lambda b: run(b, lambda x: x["g"] + x["v"], lambda x: x["g"]))
    outer = run(inner, lambda b: b["at"], lambda b: F.lit(0))["starts"]
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(inner, outer, lambda b, o: F.transform(b["starts"], lambda s: s + o)))).otherwise(none)


def with_candidates(df: DataFrame, text_col: str = "text", path_col: str | None = None, words: list[str] | None = None) -> DataFrame:
    """row (the input row), gaps (the text between values) and found: an array of (value, start, feature columns)."""
    a = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    path = F.col(f"row.`{path_col}`").cast("string") if path_col else F.lit("")
    b = a.withColumn("hits", F.regexp_extract_all(text, F.lit(CANDIDATE), 0))
    b = b.withColumn("between", F.when(F.size("hits") > 0, F.split(text, CANDIDATE)).otherwise(F.array(text)))

    def divide(hit: Column) -> Column:
        """What stands before the value, the value, and the @ that ends the password of a URL."""
        lead = F.regexp_extract(hit, LEAD, 0)
        tail = F.when(lead.startswith("://"), 1).otherwise(0)
        start, length = F.length(lead), F.length(hit)
        return F.struct(lead.alias("lead"), F.substring(hit, start + 1, length - start - tail).alias("value"), F.when(tail == 1, "@").otherwise("").alias("tail"))

    c = b.select("row", "between", F.transform("hits", divide).alias("parts"))
    gap = lambda g, i: F.concat(F.coalesce(F.get("parts", i - 1)["tail"], F.lit("")), g, F.coalesce(F.get("parts", i)["lead"], F.lit("")))
    d = c.select("row", F.transform("between", gap).alias("gaps"), F.transform("parts", lambda p: p["value"]).alias("values"))
    # Arrays are arguments of the functions, not looked up within them: Catalyst moves an expression that is used once into the lambda, for every element.
    n = F.size("values")
    around = F.zip_with(F.slice("gaps", 1, n), F.slice("gaps", F.lit(2), n), lambda x, y: F.struct(F.substring(x, F.greatest(F.lit(1), F.length(x) - (CONTEXT - 1)), F.lit(CONTEXT)).alias("before"), F.substring(y, 1, 2).alias("after")))
    # The dictionary is one literal, an array made by constant folding: a literal for each word would weigh on the driver with every rule of the optimiser.
    listed = F.split(F.lit(" ".join(words or ["-"])), " ")
    runs = lambda v: F.regexp_extract_all(F.lower(v), F.lit(r"[a-z]{3,}"), 0)
    known = F.transform("values", lambda v: F.length(F.array_join(F.filter(runs(v), lambda w: F.array_contains(listed, w)), "")))
    placed = F.zip_with("values", _starts(F.col("gaps"), F.col("values")), lambda v, s: F.struct(v.alias("value"), s.alias("start")))
    placed = F.zip_with(placed, known, lambda p, k: F.struct(p["value"].alias("value"), p["start"].alias("start"), k.alias("known")))

    def look(c: Column, at: Column) -> Column:
        made = _features(c["value"], c["known"], at["before"], at["after"], path)
        return F.struct(c["value"].alias("value"), c["start"].alias("start"), *[x.cast("double").alias(k) for k, x in made.items()])

    return d.select("row", "gaps", F.zip_with(placed, around, look).alias("found"))


def evidence() -> Column:
    """1 or 0 for findings of the corpus with evidence that is no feature of the forest, null for others."""
    plain = F.regexp_replace("value", r"[^0-9]", "")
    card = F.col("value").rlike(r"^[0-9]{12,19}$") & F.call_function("luhn_check", plain)
    return F.when(F.col("value").rlike(ISSUED), 1.0).when(card, 0.0).otherwise(F.lit(None).cast("double"))


def planted(words: list[str], n: int = PLANTED, seed: int = 7) -> list[tuple[str, str, str, float]]:
    """(text, path, value, label): n findings of each kind, secrets or not by what was planted and where."""
    rng = random.Random(seed)
    words = words if len(words) > 20 else ["river", "market", "harvest", "between", "answer", "company", "figure", "window", "produce", "season", "country", "report"]
    pick = lambda alphabet, a, b: "".join(rng.choices(alphabet, k=rng.randint(a, b)))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: rng.choice(words)
    prose = lambda k: " ".join(word() for _ in range(k))
    name = lambda: rng.choice(["token", "api_key", "secret", "password", "API_KEY", "accessKey", "client_secret", "auth_token", "DB_PASSWORD", "Credential", "private-key", "passwd", "DB_PASS", "pass", "pw", "passphrase"])

    def key() -> str:
        made = rng.choice([lambda: pick(hexa, 32, 64), lambda: pick(hexa.upper(), 32, 40), lambda: pick(alnum, 16, 48), lambda: pick(alnum + "+/", 24, 64) + rng.choice(["", "=", "=="]), lambda: pick(alnum + "_-", 20, 40)])()
        return made if any(x.isdigit() for x in made) else f"7{made[1:]}"

    def password() -> str:
        return rng.choice([lambda: pick(alnum + "!#%*?+.-", 8, 16), lambda: f"{word()}{rng.randint(2, 99)}{rng.choice('!#%?')}{pick(alnum, 1, 4)}", lambda: pick(string.ascii_letters, 9, 20)])()

    def given(value: str) -> str:
        return rng.choice(['{n} = "{v}"', "{n}={v}", "{n}: {v}", '"{n}": "{v}"', "{n} = '{v}'", "{n} => '{v}'", "export {n}={v}", "{n}:= {v}"]).format(n=name(), v=value)

    def mixed() -> str:
        """A word that is no secret's name, as texts assign values to."""
        return rng.choice(["title", "id", "region", "harvest", "color", "build", "label", "etag", "trace"])

    makers = [
        (1.0, lambda v: given(v), key),
        (1.0, lambda v: given(v), password),
        (1.0, lambda v: f"Authorization: Bearer {v}", key),
        (1.0, lambda v: f"{rng.choice(['postgres', 'https', 'amqp'])}://{word()}:{v}@{word()}.example.org/{word()}", password),
        (1.0, lambda v: f"the {rng.choice(['token', 'api key', 'secret', 'password'])} is {v}", key),
        (1.0, lambda v: rng.choice(["{n}: {v}", "Authorization: Bearer {v}", "cookie {v}", "{n}={v}"]).format(n=name(), v=v), lambda: ".".join(["eyJ" + pick(alnum, 16, 24) + "9", pick(alnum + "_-", 30, 60), pick(alnum + "_-", 30, 43)])),
        (1.0, lambda v: f"{rng.choice(['mysql -u root', 'mysqldump -h db', 'mariadb -u app'])} -p{v} {word()}", lambda: f"{rng.randint(0, 9)}{password()}".replace(":", "").replace("=", "")),
        (1.0, lambda v: f"{rng.choice(['my', 'the', 'our'])} {rng.choice(['password', 'passphrase', 'pass', 'pwd', 'api key', 'secret'])} is {v}", lambda: rng.choice([lambda: "-".join(word() for _ in range(3)) + f"-{rng.randint(1, 99)}", lambda: f"{password()[:-1].rstrip('.')}{rng.randint(1, 9)}"])()),
        (0.0, lambda v: f"{rng.choice(['ssh', 'nc', 'tool'])} -p{v} {word()}", lambda: pick(string.digits, 6, 8)),
        (0.0, lambda v: f"{rng.choice(['data:image/png', 'data:font/woff2', 'src=data:image/gif'])};base64,{v}", lambda: f"{rng.randint(0, 9)}{pick(alnum + '+/', 30, 160)}"),
        (0.0, lambda v: f"{rng.choice(['commit', 'sha256', 'md5', 'checksum:', 'digest', 'rev', 'uuid'])} {v}", lambda: pick(hexa, 32, 64)),
        (0.0, lambda v: f"https://{word()}.example/{word()}/{v}", lambda: pick(hexa, 20, 40)),
        (0.0, lambda v: f"{rng.choice(['order', 'card', 'invoice', 'no', 'isbn', 'account'])} {v}", lambda: pick(string.digits, 16, 20)),
        (0.0, lambda v: f"{word()} {v} {word()}", lambda: pick(string.digits, 16, 19)),
        (0.0, lambda v: f"{word()} {v}", lambda: "-".join(word() for _ in range(4)) + f"-{rng.randint(2000, 2030)}"),
        (0.0, lambda v: f"see {v}", lambda: "/".join(["home", word(), word(), f"{word()}{rng.randint(1, 99)}", word()])),
        (0.0, lambda v: f"{mixed()} = {v}", lambda: rng.choice([f"{word()}_{word()}_{rng.randint(10, 9999)}_{word()}", f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}"])),
        (0.0, lambda v: given(v), lambda: rng.choice(["changeme_example", "your_token_here", "example-password", "${SECRET_VALUE}", "xxxxxxxxxxxxxxxx", "placeholder", "dummy-value-1234567"])),
        (0.0, lambda v: f"{rng.choice(['the secret', 'a token', 'password', 'authority', 'Authors'])}: {v} {prose(3)}", lambda: max((word() for _ in range(8)), key=len).ljust(6, "s")),
        (0.0, lambda v: given(v), lambda: rng.choice(["string", "required", "function", "boolean", "undefined", "settings", "optional", "password", "disabled"])),
        (0.0, lambda v: f"{rng.choice(['id', 'uuid', 'trace'])} {v}", lambda: "-".join(pick(hexa, k, k) for k in (8, 4, 4, 4, 12))),
    ]
    paths = ["", "src/app/main", "notes", "web/a/b/c", "tests/fixtures/data"]
    rows = []
    for label, around, make in makers:
        for _ in range(n):
            value = make()
            rows.append((f"{prose(rng.randint(0, 6))} {around(value)} {rng.choice(['', 'and', '# ', ', ', '. '])}{prose(rng.randint(0, 5))}", rng.choice(paths), value, label))
    return rows


def labelled(docs: DataFrame, words: list[str], path_col: str | None = None, found: DataFrame | None = None) -> DataFrame:
    """value, features and label: planted findings, and those of docs with evidence, at most MOST_LABELLED of each label. found: the candidates of docs, if they are made."""
    if found is None:
        # Staged, as an explode of an array that is not would make the array again for every element.
        found = stage(with_candidates(docs, path_col=path_col, words=words).select("found"), "findings")
    # Checkpointed: a filter on a hash of many renamed columns has a constraint for every set of their names, which fills the driver's heap.
    own = cut(found.select(F.explode("found").alias("f")).select("f.*").withColumn("label", evidence()).where("label IS NOT NULL"))
    parts = [bounded_sample(own.where(F.col("label") == y), F.xxhash64("value", *FEATURES), MOST_LABELLED) for y in (0.0, 1.0)]
    rows = docs.sparkSession.createDataFrame(planted(words), "text string, path string, want string, label double")
    made = cut(with_candidates(rows, path_col="path", words=words).select("row.label", "row.want", "found")).select("label", "want", F.explode("found").alias("f")).where("f.value = want").select("f.*", "label")
    return parts[0].unionByName(parts[1]).unionByName(made)


def fit(findings: DataFrame, trees: int = 12, depth: int = 5, seed: int = 7) -> tuple[list, list]:
    """Trees as nested tuples (feature, threshold, left, right) with the share of secrets at the leaves. findings: FEATURES and label; a bounded sample."""
    sample = cut(findings.select(*FEATURES, "label").orderBy("label", *FEATURES).coalesce(1))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    model = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7).fit(rows)

    lines = iter([x.strip() for x in model.toDebugString.splitlines() if re.match(r"\s*(If|Else|Predict|Tree)", x)])

    def grow():
        line = next(lines)
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        feature, at = re.search(r"feature (\d+) <= (\S+)\)", line).groups()
        left = grow()
        next(lines)  # Else
        return int(feature), float(at), left, grow()

    forest = [grow() for line in lines if line.startswith("Tree")]
    return forest, FEATURES


def probability(model: tuple[list, list], finding: Column) -> Column:
    """The share of the forest's votes that a finding is a secret, as CASE expressions."""
    forest, names = model

    def walk(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        i, at, left, right = node
        return F.when(finding[names[i]] <= float(at), walk(left)).otherwise(walk(right))

    total = F.lit(0.0)
    for tree in forest:
        total = total + walk(tree)
    return total / float(len(forest))


def train(docs: DataFrame, path_col: str | None = None, findings: DataFrame | None = None) -> tuple[tuple[list, list], list[str]]:
    """The forest and the dictionary. findings: labelled ones with FEATURES and label, in place of planted ones and evidence."""
    words = dictionary(docs)
    return fit(findings if findings is not None else labelled(docs, words, path_col)), words


def _scored(candidates: DataFrame, model: tuple[list, list], threshold: float) -> DataFrame:
    """candidates with found as value, start, end, p and secret; other columns stay."""
    known = F.transform("found", lambda f: F.struct(f["value"].alias("value"), f["start"].alias("start"), (f["start"] + F.length(f["value"])).alias("end"), probability(model, f).alias("p")))
    return candidates.withColumn("found", known).withColumn("found", F.transform("found", lambda f: f.withField("secret", f["p"] >= threshold)))


def scan(docs: DataFrame, model: tuple[list, list], words: list[str], path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """row, gaps, and found: every candidate with its value, start, end and probability p, in text order."""
    return _scored(with_candidates(docs, path_col=path_col, words=words), model, threshold)


def redact(docs: DataFrame, model: tuple[list, list], words: list[str], path_col: str | None = None, mask: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """The rows of docs with every secret in text replaced by mask; n_chars, if there is one, follows. All rows stay."""
    s = scan(docs, model, words, path_col, threshold)
    parts = F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(F.when(F.get("found", i)["secret"], F.lit(mask)).otherwise(F.get("found", i)["value"]), F.lit(""))))
    any_secret = F.exists("found", lambda f: f["secret"])
    clean = F.when(any_secret, F.array_join(parts, "")).otherwise(F.col("row.text"))
    s = s.select("row", clean.alias("clean"))
    changed = {"text": F.col("clean"), "n_chars": F.when(F.col("clean").eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(F.length("clean").cast("long")) if "n_chars" in docs.columns else None}
    return s.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_candidates, n_secrets, and the secrets as start:end, comma-joined, for every document; the source is the path.

    Candidates and their features are made once and staged without the texts; training and scoring read them there.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    words = dictionary(docs)
    made = with_candidates(docs, path_col="source", words=words)
    held = stage(made.select("row.doc_id", "found"), "candidates")
    model = fit(labelled(docs, words, "source", held))
    found = _scored(held, model, 0.5).select("doc_id", F.size("found").cast("long").alias("n_candidates"), F.filter("found", lambda f: f["secret"]).alias("secrets"))
    spans = F.array_join(F.transform("secrets", lambda f: F.concat_ws(":", f["start"].cast("string"), f["end"].cast("string"))), ",")
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), spans.alias("spans"))
