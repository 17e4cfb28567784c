"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

The forest sees the length of a candidate, the changes of character kind in it, its entropy,
how much of it known words cover, the path or source it stands in, and the words around it. It is
trained on labelled findings that are made here by rule from a fixed seed.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_documents, slices, small_batches
from .trees import Forest, fit_forest

THRESHOLD = 0.5
AROUND = 48
"""Characters on either side whose words count as neighbours."""

N_LABELLED = 4000
"""Labelled findings the forest is trained on."""

REDACTED = "[secret]"

# Words that speak for or against a secret.
FOR = ("password passwd pwd passphrase secret token key apikey api_key access_key secret_key access auth authorization bearer "
       "credential credentials private login client_secret aws").split()
AGAINST = ("example sample dummy placeholder test fake mock changeme your redacted sha sha1 sha256 md5 hash checksum digest "
           "commit revision uuid guid etag isbn doi phone tel call card visa order invoice serial version build "
           "mail email contact").split()
DICTIONARY = set(FOR + AGAINST + (
    "the and for from with user name admin root here file data config server client value demo default hello world "
    "welcome letmein qwerty monkey master insert enter none null true false undefined xxxx abcd").split())
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "eyJ", "SG.", "npm_")
TEST_PATHS = ("test", "example", "sample", "fixture", "mock", "demo", "docs")

_RUN = re.compile(r"[A-Za-z0-9_+/=.~-]{8,}")
_ASSIGNED = re.compile(r"""[A-Za-z_-]{3,24}["']?\s{0,2}[=:]\s{0,2}["']?([^\s"'<>,;]{6,})""")
_WORD = re.compile(r"[a-z_]{2,}")
_LETTERS = re.compile(r"[a-z]{3,}")
_KINDS = {**dict.fromkeys(string.ascii_lowercase, 0), **dict.fromkeys(string.ascii_uppercase, 1), **dict.fromkeys(string.digits, 2)}

FEATURES = 16


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that may be secrets: runs with a digit, and what is assigned to a name that
    speaks for a secret. Of spans that begin at one place the longest is taken."""
    spans = {}
    for m in _RUN.finditer(text):
        run = m.group()
        if not any(c in run for c in "0123456789"):
            continue
        begin = m.start()
        if "=" in run.rstrip("="):  # name=value: the value
            begin += run.rstrip("=").rindex("=") + 1
        end = m.end() - (len(run) - len(run.rstrip(".-")))
        if end - begin >= 8:
            spans[begin] = max(end, spans.get(begin, 0))
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            name = m.group().lower()
            if any(w in name for w in ("pass", "pwd", "secret", "token", "key", "auth", "credential")):
                spans[m.start(1)] = max(m.end(1), spans.get(m.start(1), 0))
    return sorted(spans.items())


def features(value: str, before: str, after: str, path: str | None) -> list[float]:
    size = len(value)
    kinds = [_KINDS.get(c, 3) for c in value]
    counts = Counter(kinds)
    entropy = -sum(n / size * math.log2(n / size) for n in Counter(value).values())
    low = value.lower()
    known = sum(len(w) for w in _LETTERS.findall(low) if w in DICTIONARY or any(d in w for d in DICTIONARY if len(d) > 4))
    near = _WORD.findall(before.lower())
    close = before.lower().rstrip(" \"'")
    named = bool(close) and close[-1] in "=:"
    last = near[-1] if near else ""
    after_words = _WORD.findall(after.lower())
    return [
        size,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / size,
        entropy,
        entropy / math.log2(size) if size > 1 else 0.0,
        counts[2] / size,
        counts[1] / size,
        counts[3] / size,
        float(all(c in "0123456789abcdef-" for c in low)),
        max(Counter(value).values()) / size,
        known / size,
        float(value.startswith(PREFIXES)),
        float(named and any(w in last for w in FOR)),
        float(any(w in FOR for w in near[-3:])),
        float(any(w in AGAINST for w in near[-3:]) or any(w in AGAINST for w in after_words[:2])),
        float(any(p in (path or "").lower() for p in TEST_PATHS)),
        float(bool(re.fullmatch(r"[\d./:+-]+|v?\d[\w.]*\.\w+|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low)) or "/" in value.strip("/") and entropy < 4.2),
    ]


def labelled_findings(n: int = N_LABELLED, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """``(before, value, after, path, label)``: findings made by rule, half of them secrets."""
    rng = np.random.default_rng(seed)

    def text(alphabet: str, low: int, high: int | None = None) -> str:
        size = int(rng.integers(low, (high or low) + 1))
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), size))

    def one(*options):
        return options[int(rng.integers(0, len(options)))]

    hexes, upper = "0123456789abcdef", string.ascii_uppercase + string.digits
    mixed = string.ascii_letters + string.digits
    made = []
    for i in range(n):
        prose = " ".join(text(string.ascii_lowercase, 2, 8) for _ in range(int(rng.integers(0, 6))))
        after = " " + " ".join(text(string.ascii_lowercase, 2, 8) for _ in range(int(rng.integers(0, 4))))
        path = one("src0", "src7", "web", "app/config.py", "deploy/prod.env", "")
        name = one("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "auth_token", "secret_key", "private_key")
        assign = prose + " " + name + one("=", " = ", ": ", '="', ' = "', ": '")
        if i % 2:
            kind = i // 2 % 9
            if kind == 0:
                row = (prose + " ", "AKIA" + text(upper, 16), after)
            elif kind == 1:
                row = (assign, text(hexes, 12, 64), after)
            elif kind == 2:
                row = (assign, text(mixed, 10, 48), after)
            elif kind == 3:
                row = (prose + " ", one("ghp_", "gho_", "sk_live_", "npm_", "glpat-", "xoxb-", "AIza") + text(mixed, 20, 40), after)
            elif kind == 4:
                row = (prose + one(" bearer ", " authorization: bearer ", " secret key ", " token "), text(mixed + "+/", 24, 64), after)
            elif kind == 5:
                row = (prose + " ", "eyJ" + text(mixed, 20, 40) + "." + text(mixed, 30, 60) + "." + text(mixed + "_-", 30, 43), after)
            elif kind == 6:
                row = (assign, text(mixed + "!#$%&*+-", 8, 24), after)
            elif kind == 7:
                row = (prose + one(" aws secret ", " key: ", " credentials "), text(mixed + "/+", 40), after)
            else:
                row = (assign, text(string.ascii_letters, 10, 20) + text(string.digits, 1, 4), after)
            made.append((*row, path, 1))
        else:
            kind = i // 2 % 14
            test = one("tests/test_app.py", "docs/example.md", "fixtures/a.json", path)
            if kind == 0:
                row = (prose + one(" commit ", " sha256 ", " checksum ", " md5 ", " revision ", " digest: "), text(hexes, 32, 64), after)
            elif kind == 1:
                row = (prose + one(" ", " uuid ", " id "), "-".join(text(hexes, k) for k in (8, 4, 4, 4, 12)), after)
            elif kind == 2:
                row = (prose + one(" ", " card ", " visa "), text(string.digits, 13, 16), after)
            elif kind == 3:
                row = (prose + one(" ", " call ", " phone "), "-".join(text(string.digits, k) for k in (3, 3, 4)), after)
            elif kind == 4:
                row = (prose + " ", text(string.ascii_lowercase, 3, 8) + "." + text(string.digits, 2), "@mail" + text(string.digits, 1) + ".example.com" + after)
            elif kind == 5:
                row = (assign, one("changeme", "your_token_here", "yourpassword1", "xxxxxxxxxxxx", "example123", "placeholder", "password123", "test1234", "dummy_value1", "insert_key_here", "default1", "admin123"), after)
            elif kind == 6:
                row = (prose + " ", "AKIA" + one("IOSFODNN7EXAMPLE", "EXAMPLE" + text(upper, 9), "X" * 16), after)
            elif kind == 7:
                row = (prose + " ", one("v", "") + ".".join(text(string.digits, 1, 3) for _ in range(3)) + one("-beta1", ".tar.gz", ""), after)
            elif kind == 8:
                row = (prose + " ", "/".join(text(string.ascii_lowercase, 3, 9) for _ in range(3)) + text(string.digits, 1, 4), after)
            elif kind == 9:
                row = (prose + one(" ", " order ", " invoice ", " serial "), text(string.digits, 8, 20), after)
            elif kind == 10:
                row = (prose + " ", text(string.ascii_lowercase, 4, 9) + "_" + text(string.ascii_lowercase, 3, 9) + text(string.digits, 1, 2), after)
            elif kind == 11:
                row = (prose + one(" ", " on "), "-".join(text(string.digits, k) for k in (4, 2, 2)), after)
            elif kind == 12:
                row = (prose + one(" ", " build ", " version ") , text(string.ascii_lowercase, 5, 14) + text(string.digits, 1, 4), after)
            else:
                row = (prose + one(" see ", " at "), text(string.ascii_lowercase, 4, 8) + ".example." + one("com", "org") + "/" + text(string.ascii_lowercase, 2, 6) + "/" + text(string.digits, 3, 5), after)
            made.append((*row, test, 0))
    return made


@cache
def trained_forest(n: int = N_LABELLED) -> Forest:
    found = labelled_findings(n)
    rows = np.array([features(v, b[-AROUND:], a[:AROUND], p) for b, v, a, p, _ in found], dtype=float)
    return fit_forest(rows, np.array([f[-1] for f in found], dtype=float))


def scan(texts: list[str | None], paths: list[str | None], forest: Forest, threshold: float = THRESHOLD):
    """``(row, begin, end, score)`` of the secrets in each text, in order; candidates that
    overlap are one secret, with the best of their scores."""
    found = [
        (i, begin, end)
        for i, text in enumerate(texts)
        if text
        for begin, end in candidates(text)
    ]
    if not found:
        return []
    rows = np.array(
        [
            features(texts[i][b:e], texts[i][max(0, b - AROUND) : b], texts[i][e : e + AROUND], paths[i])
            for i, b, e in found
        ]
    )
    scores = forest.predict(rows)
    secrets = []
    for (i, begin, end), score in zip(found, scores.tolist()):
        if score < threshold:
            continue
        if secrets and secrets[-1][0] == i and begin < secrets[-1][2]:
            _, first, last, best = secrets.pop()
            begin, end, score = first, max(last, end), max(best, score)
        secrets.append((i, begin, end, score))
    return secrets


def _paths(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column("source").to_pylist()


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, start, length, score, digest)``: every secret in ``docs(doc_id, text, source)``.

    Positions count characters; ``digest`` is the SHA-256 of the value, which is not given
    out. Null and empty texts hold none; a null id or source is carried as it is; rows that
    repeat are scanned each by itself. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained_forest())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            hits = scan(texts, _paths(batch), shared.value, threshold)
            row, begin, end, score = zip(*hits) if hits else ((),) * 4
            digest = [hashlib.sha256(texts[i][b:e].encode()).hexdigest() for i, b, e in zip(row, begin, end)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row, pa.int64())),
                    pa.array(begin, pa.int64()),
                    pa.array([e - b for b, e in zip(begin, end)], pa.int64()),
                    pa.array(score, pa.float64()),
                    pa.array(digest, pa.string()),
                ],
                names=["doc_id", "start", "length", "score", "digest"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text", "source").mapInArrow(
        found, f"doc_id {key}, start long, length long, score double, digest string"
    )


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced; rows and other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(trained_forest())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index("text")
    has_source = "source" in docs.columns

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            paths = _paths(batch) if has_source else [None] * len(texts)
            for i, begin, end, _ in reversed(scan(texts, paths, shared.value, threshold)):
                texts[i] = texts[i][:begin] + REDACTED + texts[i][end:]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return small_batches(docs).mapInArrow(cleaned, schema)


def op10_secret_scan(spark, sf_dir):
    return find_secrets(read_documents(spark, sf_dir, "doc_id", "text", "source"))
