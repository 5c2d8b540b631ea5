"""Corpus encoding with a public byte-level BPE vocabulary, contracted by recursive SQL in each partition.

Each task splits its texts into words by the vocabulary's published pattern and keeps, for as long as its worker lives,
a table of the words it has met. Words not met before become token-position rows of an embedded DuckDB, where one
recursive query joins every adjacent pair with the merge table, contracts each word's leftmost pair of minimum rank and
repeats until no pair of any word merges; an ordered aggregation then decodes the remaining rows to the word's ids. A
text's ids are gathered from the table with array operations. Nothing is shuffled.

The recursion keeps a word of n bytes in up to n states of up to n rows, so words beyond ``LONG_WORD`` bytes (runs of
thousands of letters or marks) are contracted by the same rule over a heap instead, in n log n steps.

Defined cases: null and empty text give an empty list; strings that look like special tokens are ordinary text; a
repeated row gives a repeated row; a null id stays null; other columns are not read. The vocabulary is read by the
driver from the path given and sent to the executors; a file over ``MAX_VOCABULARY`` bytes is refused.
"""

from __future__ import annotations

import heapq
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
MAX_VOCABULARY = 64 << 20
#: The vocabulary's published split pattern, with white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
LONG_WORD = 256
#: Words contracted by one query, texts' characters handled at a time, words kept by a worker.
QUERY_WORDS, SLICE_CHARS, KEPT_WORDS = 20_000, 8_000_000, 1_000_000

IDS = "doc_id BIGINT, ids ARRAY<INT>"

CONTRACT = """
WITH RECURSIVE step(it, w, pos, tok) AS (
    SELECT 0, w, pos, tok FROM start
    UNION ALL
    SELECT it + 1, w, pos, CASE WHEN pos = spot THEN res ELSE tok END
    FROM (
        SELECT *, min(CASE WHEN rank = best THEN pos END) OVER (PARTITION BY w) AS spot
        FROM (
            SELECT p.*, m.rank, m.res, min(m.rank) OVER (PARTITION BY p.w) AS best
            FROM (SELECT *, lead(tok) OVER word AS nxt, lag(pos) OVER word AS prev FROM step WINDOW word AS (PARTITION BY w ORDER BY pos)) p
            LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt
        )
        WHERE best IS NOT NULL
    )
    WHERE prev IS DISTINCT FROM spot
)
SELECT w, list(tok ORDER BY pos) AS ids
FROM step SEMI JOIN (SELECT w, max(it) AS it FROM step GROUP BY w) last USING (w, it)
GROUP BY w ORDER BY w
"""


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


def load_vocabulary(path: str) -> dict[str, np.ndarray]:
    """Ids of the single bytes and the merge table (left id, right id, result id, in order of rank)."""
    if os.path.getsize(path) > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY} bytes")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, letters = model["vocab"], _byte_letters()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    as_ids = lambda words: np.array([vocab[w] for w in words], dtype=np.int32)
    return {"byte": as_ids(letters[b] for b in range(256)), "l": as_ids(a for a, _ in pairs), "r": as_ids(b for _, b in pairs), "res": as_ids(a + b for a, b in pairs)}


class Encoder:
    """A worker's connection and table of words."""

    def __init__(self, vocabulary: dict[str, np.ndarray]):
        import duckdb
        import regex

        self.split = regex.compile(PATTERN).findall
        self.vocabulary = vocabulary
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        n = len(vocabulary["l"])
        merges = pa.table({"l": vocabulary["l"], "r": vocabulary["r"], "rank": np.arange(n, dtype=np.int32), "res": vocabulary["res"]})
        self.con.register("given", merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.con.unregister("given")
        self._ranks: dict | None = None
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word by the recursive query."""
        sizes = np.array([len(b) for b in words], dtype=np.int64)
        tok = self.vocabulary["byte"][np.frombuffer(b"".join(words), dtype=np.uint8)]
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": (np.arange(len(tok)) - first).astype(np.int32), "tok": tok})
        self.con.register("start", start)
        ids = self.con.sql(CONTRACT).to_arrow_table().column("ids").combine_chunks()
        self.con.unregister("start")
        flat, at = ids.values.to_numpy(zero_copy_only=False).astype(np.int32), ids.offsets.to_numpy()
        return [flat[a:b] for a, b in zip(at, at[1:])]

    def contract_long(self, word: bytes) -> np.ndarray:
        """The same contraction of one long word: a heap of (rank, position) over a linked list."""
        if self._ranks is None:
            v = self.vocabulary
            self._ranks = {(int(a), int(b)): (k, int(c)) for k, (a, b, c) in enumerate(zip(v["l"], v["r"], v["res"]))}
        ranks, n = self._ranks, len(word)
        tok: list = [int(self.vocabulary["byte"][b]) for b in word]
        nxt, prev = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, tok[i], tok[i + 1]) for i in range(n - 1) if (m := ranks.get((tok[i], tok[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if tok[i] == a else -1
            if j < 0 or tok[j] != b:
                continue
            tok[i], tok[j], nxt[i] = ranks[a, b][1], None, nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            for p, q in ((prev[i], i), (i, nxt[i])):
                if p >= 0 and q >= 0 and (m := ranks.get((tok[p], tok[q]))):
                    heapq.heappush(heap, (m[0], p, tok[p], tok[q]))
        return np.array([t for t in tok if t is not None], dtype=np.int32)

    def learn(self, words: list[str]) -> None:
        coded = [(w, w.encode("utf-8", "surrogatepass")) for w in words]
        short = [x for x in coded if len(x[1]) <= LONG_WORD]
        rows: list[tuple[str, np.ndarray]] = [(w, self.contract_long(b)) for w, b in coded if len(b) > LONG_WORD]
        for k in range(0, len(short), QUERY_WORDS):
            part = short[k : k + QUERY_WORDS]
            rows += zip((w for w, _ in part), self.contract([b for _, b in part]))
        sizes = np.array([len(ids) for _, ids in rows], dtype=np.int64)
        for w, _ in rows:
            self.place[w] = len(self.place)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, *(ids for _, ids in rows)])

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        lists = [self.split(t) if t else [] for t in texts]
        if len(self.place) > KEPT_WORDS:
            self.clear()
        if new := [w for w in dict.fromkeys(w for ws in lists for w in ws) if w not in self.place]:
            self.learn(new)
        counts = [len(ws) for ws in lists]
        at = np.fromiter((self.place[w] for ws in lists for w in ws), dtype=np.int64, count=sum(counts))
        sizes = self.sizes[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.starts[at] - total[:-1], sizes) + np.arange(total[-1])]
        offsets = total[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(name: str, shared) -> Encoder:
    """The encoder that this worker keeps; the module, unlike a task's closure, outlives the task."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(shared.value)
    return _ENCODERS[name]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        encoder = encoder_for(vocabulary, shared)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            a, chars = 0, 0
            for b, text in enumerate(texts, 1):
                chars += len(text) if text else 0
                if chars >= SLICE_CHARS or b == len(texts):
                    yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), encoder.encode(texts[a:b])], schema=kind)
                    a, chars = b, 0

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, IDS)


def decode(ids: list[int], vocabulary: str = DEFAULT_VOCABULARY) -> str:
    """The text of one list of ids, for round trips."""
    with open(vocabulary, encoding="utf-8") as f:
        words = {i: w for w, i in json.load(f)["model"]["vocab"].items()}
    back = {ch: b for b, ch in _byte_letters().items()}
    return bytes(back[ch] for i in ids for ch in words[i]).decode("utf-8", "replace")
