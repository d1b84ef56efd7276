"""Secrets in texts: fixed patterns, and strings that a tokenizer compresses badly.

A byte-pair vocabulary spends few tokens on words and many on random strings, so a low count of characters per token exposes
keys that no pattern names. Runs of key characters with letters and digits are scored that way, after known digests (hexadecimal
strings of a digest's length), UUIDs and identifiers of joined words are set aside; where a run is no key as a whole, its pieces
of 16 characters or more between ``/ _ = -`` are scored by themselves, without need of a digit. Shorter ones are not looked for.

Offsets count code points, ends are exclusive. Defined results: a null text is the empty one, with no spans and the digest of the
empty string; a span found by both a pattern and the score keeps the pattern's kind alone; repeated rows come back as often as they
went in; an empty table gives an empty one; only the id and text are read. A run of any length is scored whole, in pieces of
``PIECE`` characters, so time is linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The base patterns and the least length of what they find, in the order of the kinds.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "random")
#: Hex runs shorter than this cannot pass, and searching for long ones alone is the same and faster.
LONG_HEX = re.compile(rf"[0-9a-f]{{{LEAST['hex']},}}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LONG_RUN = 20
#: Pieces of a run that are scored by themselves, so that words around a key do not hide it.
KEY = re.compile(r"[A-Za-z0-9+]{16,}")
UUID = re.compile(r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\Z")
DIGEST = re.compile(r"(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z")
#: What an identifier or path is joined from; random strings change between these every character or two.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
PART_LENGTH = 4
PIECE = 64
RATIO = 2.4
#: For pieces, which need no digit: words have 2 characters per token or more even in capitals, random ones 1.4 on average.
KEY_RATIO = 1.9


@cache
def encoder(data: bytes) -> tiktoken.Encoding:
    """From the bytes of a vocabulary file; a run of letters, digits or others is cut at ``PIECE`` characters."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("runs", pat_str=rf"[A-Za-z]{{1,{PIECE}}}|[0-9]{{1,{PIECE}}}|[^A-Za-z0-9]{{1,{PIECE}}}", mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def random_spans(text: str, taken: list[tuple[int, int, str]], tokens: tiktoken.Encoding, ratio: float) -> list[tuple[int, int, str]]:
    """Runs with few characters per token that overlap no span of ``taken`` (sorted by start)."""
    found, at, reach = [], 0, 0
    for m in RUN.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        run = m[0]
        if reach > m.start() or UUID.match(run) or DIGEST.match(run):
            continue
        mixed = len(run) >= LONG_RUN and re.search("[0-9]", run) and re.search("[A-Za-z]", run)
        if mixed and len(run) < PART_LENGTH * len(PART.findall(run)) and len(run) < ratio * len(tokens.encode_ordinary(run)):
            found.append((m.start(), m.end(), "random"))
            continue
        for key in KEY.finditer(run):
            if re.search("[A-Za-z]", key[0]) and not DIGEST.match(key[0]) and len(key[0]) < KEY_RATIO * len(tokens.encode_ordinary(key[0])):
                found.append((m.start() + key.start(), m.start() + key.end(), "random"))
    return found


def _line(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, ratio: float = RATIO) -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` and ``n_random`` of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    with open(vocabulary, "rb") as f:  # under a MB, so executors get it with the job and need no such folder
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text"):
                t = t.as_py() or ""
                base = base_spans(t)
                more = random_spans(t, base, encoder(shared.value), ratio)
                kinds = [k for _, _, k in base]
                every = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))
                out.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_line(base).encode()).hexdigest(), _line(every), len(more)))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
