"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are private key blocks, values assigned to a telling name, words with a digit, and words without one that are
long or begin as known tokens do. Each is described by its length, the transitions between its characters, how much of
it dictionary words cover, its path (the document's source) and the words beside it. A random forest trained from labelled
findings decides. Every search is a single scan: the work is linear in the text.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import map_texts

#: The fewest characters of a word, of a word without a digit, and of an assigned value that are candidates.
LEAST, LEAST_PLAIN, LEAST_ASSIGNED = 12, 20, 4
#: The neighbourhood that is described: so many characters on either side, and so many words of those before.
BESIDE, WORDS_BESIDE = 40, 3
_DIGIT = re.compile(r"\d")
_ASSIGNED = re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key|credential)s?[\"']?\s{0,2}[:=]\s{0,2}[\"']?([^\s\"',;]+)", re.I)
_BEGIN = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
#: How known tokens begin.
_BEGINNINGS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "sk-", "sk_", "AIza", "glpat-", "npm_")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST_PLAIN)
_KNOWN = re.compile(f"(?:{'|'.join(_BEGINNINGS)})[A-Za-z0-9_-]+")
_VALUE = re.compile(r"[A-Za-z0-9+/_=.~@:-]+")
_TELLING = re.compile(r"pass(?:word|wd)?|pwd|secret|token|key|auth|credential|bearer", re.I)
_HARMLESS = re.compile(r"sha\d*|md5|digest|checksum|commit|uuid|guid|hash|version|revision|etag|phone|call|order|serial|isbn|build|ref", re.I)
_TEST_PATH = re.compile(r"test|example|sample|fixture|mock|docs?/|lock$", re.I)
_PREFIX = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_|github_pat_|xox[abprs]-|sk[-_]|eyJ[\w-]+\.eyJ|AIza|-----BEGIN|glpat-|npm_")
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$", re.I)
#: Words whose letters speak against chance.
DICTIONARY = """account admin alpha android april august beta build button change check client cloud color column config
content control count create custom data date debug december default delete demo device document download email error
event example false february field file final first folder format function general global group header height hidden
home host image index info input internal january july june label last layout level library linux list local login main
march master member message method mobile model module name network null number object october online option order
package page panel param parent password path phone photo picture placeholder platform please point post private product
profile project public query record release report request response result return root sample script search section
secret select september server service session simple size source start state status stream string style submit
system table target template test text theme time title token total type update upload user value version video view
web width window world xxxx your""".split()
_PARTS = re.compile("|".join(sorted(DICTIONARY, key=lambda x: (-len(x), x))), re.I)
NAMES = ("length", "switches", "distinct", "entropy", "covered", "digits", "upper", "hex", "prefix", "uuid", "test_path", "telling", "assigned", "harmless", "mark", "dotted")


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


@lru_cache(maxsize=4096)
def _own_features(value: str) -> tuple[float, ...]:
    n = len(value)
    classes = [_class(c) for c in value]
    counts = Counter(value)
    return (
        math.log2(len(value) + 1), sum(a != b for a, b in zip(classes, classes[1:])) / max(1, n - 1), len(counts) / n,
        -sum(v / n * math.log2(v / n) for v in counts.values()), sum(len(m) for m in _PARTS.findall(value)) / n,
        classes.count(2) / n, classes.count(1) / n, float(all(c in string.hexdigits for c in value)),
        float(bool(_PREFIX.match(value))), float(bool(_UUID.match(value))),
    )


def features(value: str, before: str, after: str, path: str) -> list[float]:
    """The numbers of NAMES for a candidate."""
    near = " ".join(before.split()[-WORDS_BESIDE:])
    return [
        *_own_features(value), float(bool(_TEST_PATH.search(path))), float(bool(_TELLING.search(near))), float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(bool(_HARMLESS.search(near) or _HARMLESS.match(after.strip()[:10]))), float("@" in value or "://" in value), value.count(".") / len(value),
    ]


def _blocks(text: str) -> list[tuple[int, int]]:
    """Private key blocks, from a beginning to the next end; a beginning without an end ends the search."""
    out, begin = [], _BEGIN.search(text)
    while begin:
        end = _END.search(text, begin.end())
        if not end:
            break
        out.append((begin.start(), end.end()))
        begin = _BEGIN.search(text, end.end())
    return out


def _assigned(text: str) -> list[tuple[int, int]]:
    """Values after a telling name and a sign."""
    return [m.span(1) for m in _ASSIGNED.finditer(text)] if "=" in text or ":" in text else []


def _words(text: str) -> list[tuple[int, int]]:
    """Words that may be secrets on their own: with a digit, or long, or with the beginning of a known token."""
    out, at = [], 0
    while m := _DIGIT.search(text, at):
        start, end = m.start(), m.end()
        while start > at and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        at = end
        for v in _VALUE.finditer(text, start, end):
            if _DIGIT.search(v[0]):
                cut = v[0].rfind("=", 0, -1) + 1
                out.append((v.start() + (cut if len(v[0]) - cut >= LEAST else 0), v.end()))
    # both patterns are dear, and most texts can't match them
    plain = list(_LONG.finditer(text)) if max(map(len, text.split()), default=0) >= LEAST_PLAIN else []
    plain += _KNOWN.finditer(text) if any(x in text for x in _BEGINNINGS) else ()
    return out + [m.span() for m in plain if not _DIGIT.search(m[0])]


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the candidates of a text, in order, without overlaps.

    A block comes before an assigned value, that before a word, and of two words the one that begins first.
    """
    out: list[tuple[int, int, str]] = []
    for kind, found in (("block", _blocks(text)), ("assigned", _assigned(text)), ("word", _words(text))):
        taken, own, done = [x[:2] for x in out], [], 0
        for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
            if kind != "block":
                while end > start and text[end - 1] in ".,:;=-":
                    end -= 1
            k = bisect_right(taken, (start, len(text) + 1))
            free = start >= done and not (k and taken[k - 1][1] > start) and not (k < len(taken) and taken[k][0] < end)
            if free and end - start >= (LEAST if kind == "word" else LEAST_ASSIGNED):
                own.append((start, end, kind))
                done = end
        out = sorted(out + own)
    return out


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (code points), kind, value and features of every candidate of whole texts, and text_hash.

    Null and empty texts have none; a null source is an empty path. Repeated rows give theirs each. text_hash (xxhash64 of
    the text) tells rows apart that share a doc_id or have none.
    """

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("doc_id", "text_hash", "start", "end", "kind", "value", "features")}
        for doc, own, text, path in zip(*(rows.column(k).to_pylist() for k in ("doc_id", "text_hash", "text", "source"))):
            for start, end, kind in spans(text or ""):
                value = text[start:end]
                row = (doc, own, start, end, kind, value, features(value, text[max(0, start - BESIDE) : start], text[end : end + BESIDE], path or ""))
                for k, v in zip(out, row):
                    out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    schema = "doc_id long, text_hash long, start int, end int, kind string, value string, features array<double>"
    return map_texts(docs.select("doc_id", "text", "source", F.xxhash64("text").alias("text_hash")), run, schema)


def labelled_findings(n: int = 6000, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, label) of made-up findings, as a reviewer would label them: half are secrets."""
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexes, mixed, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    word = lambda: "".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(6)) + " "
    name = lambda: r.choice(["password", "passwd", "token", "secret", "api_key", "API_KEY", "auth_token", "db_password", "credential", "client_secret"])
    sign = lambda: r.choice(["=", " = ", ": ", '="', ' = "', '": "'])
    path = lambda: r.choice(["src3", "app/main.py", "src11", "web", "config/prod.yml", "notes", "", "deploy.sh", "src0"])
    fake = lambda: r.choice(["tests/test_login.py", "docs/example.md", "fixtures/a.json", "package.lock"])
    plain = ["none", "null", "true", "false", "required", "string", "optional", "changeme", "hidden", "password", "unknown", "default", *DICTIONARY]
    leet = str.maketrans("aeios", "4310$")
    short = lambda: r.choice([
        lambda: word().capitalize() + word().translate(leet) + r.choice("!&#%?*") + some(string.digits, r.randint(1, 3)), lambda: word() + word() + some(string.digits, r.randint(1, 3)) + r.choice("!&#%?*"),
        lambda: r.choice(DICTIONARY) + some(string.digits, r.randint(0, 3)) + r.choice("!&#%?*"), lambda: some(mixed, r.randint(6, 11)), lambda: some(mixed + "!&#%?*", r.randint(6, 11)),
    ])()
    secret = [
        lambda: ("AKIA" + some(upper, 16), prose()), lambda: (r.choice(["ghp_", "gho_"]) + some(mixed, 36), prose()), lambda: ("sk-" + some(mixed, r.randint(24, 48)), prose()),
        lambda: ("xoxb-" + some(string.digits, 11) + "-" + some(mixed, 24), prose()), lambda: ("eyJ" + some(mixed, 20) + ".eyJ" + some(mixed, 40) + "." + some(mixed, 30), prose()),
        lambda: (some(hexes, r.choice([18, 20, 24, 32, 40, 64])), prose() + name() + sign()), lambda: (some(mixed, r.randint(14, 44)), prose() + name() + sign()),
        lambda: (some(mixed + "+/", 40), prose() + name() + sign()), lambda: ("-----BEGIN PRIVATE KEY-----\n" + some(mixed, 400) + "\n-----END PRIVATE KEY-----", "\n"), lambda: ("AIza" + some(mixed, 35), prose()),
        lambda: (short(), prose() + name() + sign()), lambda: (short(), prose() + name() + sign()),
        lambda: (r.choice(["ghp_", "glpat-", "npm_", "sk-"]) + some(string.ascii_letters, r.randint(24, 36)), prose()),
    ]
    harmless = [
        lambda: (some(hexes, r.choice([32, 40, 64])), prose() + r.choice(["sha256", "md5 ", "commit ", "checksum: ", "digest=", "etag "])),
        lambda: ("-".join(some(hexes, k) for k in (8, 4, 4, 4, 12)), prose() + r.choice(["", "uuid ", "id=", "request "])),
        lambda: (word() + "." + some(string.digits, 2) + "@" + word() + r.choice([".com", ".org", ".net"]), prose()), lambda: ("+" + some(string.digits, r.randint(11, 13)), prose() + r.choice(["", "phone ", "call "])),
        lambda: (".".join(some("123456789", 2) + some("0", r.randint(0, 1)) for _ in range(4)) + ":8080", prose()), lambda: ("https://" + word() + word() + ".com/" + word() + some(string.digits, 4), prose()),
        lambda: (r.choice(["2024", "2019"]) + "-0" + some("123456789", 1) + "-1" + some("0123456789", 1) + "T10:0" + some(string.digits, 1) + ":00", prose()), lambda: (word() + word() + word() + some(string.digits, r.randint(1, 4)), prose()),
        lambda: (r.choice(["changeme", "your-password-here", "example-token-", "placeholder", "xxxxxxxx", "test-secret-"]) + some(string.digits, r.randint(3, 5)), prose() + name() + sign()),
        lambda: (some(string.digits, r.randint(12, 18)), prose() + r.choice(["", "order ", "serial ", "isbn ", "ref "])), lambda: (word() + "-" + word() + "-" + some(string.digits, 2) + "-" + word(), prose()),
        lambda: (r.choice(DICTIONARY) + "_" + r.choice(DICTIONARY) + "_" + r.choice(DICTIONARY) + some(string.digits, 1), prose()), lambda: ("v" + ".".join(some(string.digits, 2) for _ in range(4)) + "-" + word(), prose() + "version "),
        lambda: (r.choice(plain), prose() + name() + sign()), lambda: (word() + word(), prose() + name() + sign()),
        lambda: ("".join(word() for _ in range(5))[:30] + "en" * 6, prose()), lambda: (r.choice("-=_") * r.randint(20, 60), prose()),
        lambda: (r.choice("-_/").join(r.choice([word(), r.choice(DICTIONARY)]) for _ in range(6)), prose()),
    ]
    out = []
    for i in range(n):
        if i % 2:
            value, before = r.choice(secret)()
            out.append((value, before, " " + prose(), path(), 1))
        else:
            shown = r.random() < 0.1  # a secret's form in a test or example file
            value, before = r.choice(secret[5:8] if shown else harmless)()
            out.append((value, before, " " + prose(), fake() if shown else r.choice([path(), path(), fake()]), 0))
    return out


def fit(spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None, trees: int = 30, depth: int = 9, seed: int = 11) -> RandomForestClassificationModel:
    """A random forest from labelled findings, (value, before, after, path, label) each; by default, made-up ones."""
    rows = [(features(v, b, a, p), float(y)) for v, b, a, p, y in (labelled_findings() if findings is None else findings) if v]
    data = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").coalesce(1)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(data)


def scan(docs: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """doc_id, start, end, kind, value, score (0 to 1), is_secret and text_hash of every candidate of every row.

    ``docs`` has doc_id, text and source (the path). Null and empty texts have no candidates and a null source is an
    empty path; long texts are read whole. Repeated rows give their findings each. Other columns are not read.
    """
    found = candidates(docs).withColumn("features", array_to_vector("features"))
    scored = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "end", "kind", "value", "score", (F.col("score") >= 0.5).alias("is_secret"), "text_hash")


def redact(docs: DataFrame, model: RandomForestClassificationModel, mark: str = "<secret>") -> DataFrame:
    """The rows of ``docs`` with each secret of their text replaced by ``mark``; n_chars, where there is one, follows.

    All rows stay. A row is known by its doc_id (which may be null) and the hash of its text, so rows that share a
    doc_id are each cut by their own findings, which replace only the value that they found at its place.
    """
    secret = scan(docs, model).where("is_secret").select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__of"), "start", "end", "value")
    marks = secret.groupBy("__doc", "__of").agg(F.array_sort(F.collect_set(F.struct("start", "end", "value"))).alias("__spans"))
    own = docs.withColumn("__own", F.xxhash64("text"))
    both = own.join(marks.hint("merge"), own["doc_id"].eqNullSafe(marks["__doc"]) & (own["__own"] == marks["__of"]), "left")

    @F.pandas_udf("string")
    def replaced(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for x, spans_ in zip(text, found):
            parts, done = [], 0
            for s in () if x is None else spans_:
                if s["start"] >= done and x[s["start"] : s["end"]] == s["value"]:
                    parts += [x[done : s["start"]], mark]
                    done = s["end"]
            out.append(x if x is None else "".join(parts) + x[done:])
        return pd.Series(out, dtype=object)

    hit = F.col("__spans").isNotNull()
    cut = replaced(F.when(hit, F.col("text")), F.col("__spans"))  # other texts don't go to Python
    text = F.when(hit, cut).otherwise(F.col("text"))
    out = both.select(*[text.alias(c) if c == "text" else own[c] for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
