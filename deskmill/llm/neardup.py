"""Near-duplicate records by a token-group matrix; exact for its threshold, without pairwise comparison.

1. *Tokens.* A text's tokens are its sequences of ``k`` words, hashed to 40 bits and salted by source, so that several
   tables share one run. Copies within a batch are folded into one member that lists its records.
2. *Groups.* Members with the same least tokens under a few hashes (likely for similar texts) are brought together and cut
   into groups of at most ``GROUP`` members; a frequent key is split by the engine's skew handling, since any grouping
   gives the same result. A group is stored with its members' token sets.
3. *Matrix.* A sketch of fixed size counts over all texts how many members hold a token. Ordered from rare to
   frequent, a member's index prefix and probe prefix are the tokens of which any partner over the threshold must share
   ``SHARED`` (or all it has, if fewer). The matrix holds the union of its members' prefix tokens for each group, with
   bounds of their sizes and of what may follow; tokens that the sketch proves to be held once, and probe tokens that no
   index holds, are left out.
4. *Bounds.* Matrix rows meet by token. A pair of groups qualifies by sizes, by number of shared tokens and by the
   largest overlap that can still follow; all other groups are never opened.
5. *Opening.* Only qualifying groups are joined, and each pair of their members is verified on the whole token sets.

Nothing grows with the corpus on the driver or in a broadcast: the two sketches have fixed sizes (``BITS``). Where a
corpus has many more tokens than slots, counts only tell frequent tokens from rare ones and tokens held once are no
longer left out: the matrix then has every prefix token of every text, and the result stays the same.

Defined cases: null and blank texts and texts under ``k`` words have no tokens and never count; records delivered
several times count once; copies are pairs of similarity 1; equal ids in different sources are different records.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.llm import words as W
from deskmill.session import discard, materialise

GROUP, SHARED, BITS, DEPTH, PARTS, MAX_IDS = 32, 3, 24, 2, 32, 50_000
INDEX_BITS = 24
#: Ids of a list of copies that meet at a time.
BLOCK = 500
#: Hashes whose least tokens make up a group's key: texts that only share boilerplate rarely agree in all of them.
KEY_HASHES = 3
_TOKEN_BITS = np.uint64(40)

SETS = "src STRING, gkey BIGINT, cls BINARY, n INT, ids ARRAY<BIGINT>, toks BINARY"
GROUPS = "gid BIGINT, src STRING, sizes ARRAY<INT>, counts ARRAY<INT>, ids ARRAY<BIGINT>, toks BINARY"


def pack(tokens: np.ndarray) -> bytes:
    """Five bytes for each token: the low halves, then the high bytes."""
    return tokens.astype("<u4").tobytes() + (tokens >> np.uint64(32)).astype(np.uint8).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // 5
    return np.frombuffer(blob, "<u4", n).astype(np.uint64) | (np.frombuffer(blob, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32))


def token_sets(texts: list[str | None], k: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all texts, each text's ones sorted and distinct; offsets)."""
    hashes, at = W.hash_batch([W.words(t) for t in texts])
    mixed = W.mix(hashes, k, salt) >> np.uint64(24)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))[: len(mixed)]
    inside = np.arange(len(mixed)) + k <= at[doc + 1] if len(mixed) else np.empty(0, dtype=bool)
    both = np.sort((doc[inside].astype(np.uint64) << _TOKEN_BITS) | mixed[inside])
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    offsets = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.uint64) << _TOKEN_BITS)
    return both & np.uint64((1 << 40) - 1), offsets


def _scramble(tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (tokens ^ (tokens >> np.uint64(19))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sets(records: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for src, rows in batch.groupby("src", sort=False):
                ids = rows["id"].to_numpy()
                for a in range(0, len(rows), 4000):
                    tokens, at = token_sets(list(rows["text"].iloc[a : a + 4000]), k, xxhash.xxh3_64_intdigest(str(src)) >> 1)
                    least = [_scramble(tokens ^ np.uint64(h << 41)) for h in range(KEY_HASHES)]
                    seen: dict[bytes, list] = {}
                    for i, (p, q) in enumerate(zip(at, at[1:])):
                        if p < q:
                            blob = pack(tokens[p:q])
                            member = seen.setdefault(xxhash.xxh3_128_digest(blob), [xxhash.xxh3_64_intdigest(b"".join(x[p:q].min().tobytes() for x in least)) - (1 << 63), int(q - p), blob, []])
                            member[3].append(int(ids[a + i]))
                    if seen:
                        yield pd.DataFrame([(src, g, c, n, x, b) for c, (g, n, b, x) in seen.items()], columns=["src", "gkey", "cls", "n", "ids", "toks"])

    return records.mapInPandas(run, SETS)


def _groups(sets: DataFrame) -> DataFrame:
    def run(batches):
        base, seq = TaskContext.get().partitionId() << 32, 0
        members: list[list] = []
        key = None
        out: list[tuple] = []

        def close():
            nonlocal seq, members
            if members:
                out.append((base + seq, key[0], [m[1] for m in members], [len(m[2]) for m in members], [i for m in members for i in m[2]], b"".join(m[3] for m in members)))
                seq += 1
            members = []

        for batch in batches:
            for src, g, cls, n, ids, toks in zip(batch["src"], batch["gkey"], batch["cls"], batch["n"], batch["ids"], batch["toks"]):
                if (src, g) != key:
                    close()
                    key = (src, g)
                if members and members[-1][0] == cls and len(members[-1][2]) < MAX_IDS:
                    members[-1][2] = list(dict.fromkeys([*members[-1][2], *ids]))
                    continue
                if len(members) == GROUP:
                    close()
                members.append([cls, n, list(dict.fromkeys(ids)), toks])
            if out:
                yield pd.DataFrame(out, columns=["gid", "src", "sizes", "counts", "ids", "toks"])
                out.clear()
        close()
        if out:
            yield pd.DataFrame(out, columns=["gid", "src", "sizes", "counts", "ids", "toks"])

    return sets.hint("rebalance", F.col("gkey")).sortWithinPartitions("src", "gkey", "cls").mapInPandas(run, GROUPS)


def _members(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, member of each, size of each member, group row of each member) of a batch of groups."""
    tokens, sizes, rows = [], [], []
    for r, (n, blob) in enumerate(zip(batch["sizes"], batch["toks"])):
        at = 0
        for x in n:
            tokens.append(unpack(blob[at : at + 5 * x]))
            at += 5 * x
        sizes += list(n)
        rows += [r] * len(n)
    sizes_ = np.array(sizes, dtype=np.int64)
    return (np.concatenate(tokens) if tokens else np.empty(0, np.uint64)), np.repeat(np.arange(len(sizes_)), sizes_), sizes_, np.array(rows, dtype=np.int64)


def _slots(tokens: np.ndarray, bits: int, row: int) -> np.ndarray:
    return (_scramble(tokens ^ np.uint64((row + 7) << 48)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _counted(groups: DataFrame, pick, bits: int, depth: int = 1) -> np.ndarray:
    """Saturated counts of the picked tokens over all groups by ``depth`` hashes: depth * 2 ** bits bytes, whatever the corpus' size."""
    step = (1 << bits) // PARTS

    def count(batches):
        total = np.zeros((depth, 1 << bits), dtype=np.uint16)
        for batch in batches:
            tokens = pick(batch)
            for row in range(depth):
                slots = np.sort(_slots(tokens, bits, row))
                first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else slots
                at, n = slots[first], np.diff(np.append(first, len(slots)))
                total[row, at] = np.minimum(total[row, at].astype(np.int64) + n, 65_535)
        lane = TaskContext.get().partitionId() >> 5
        for part, piece in enumerate(total.reshape(depth * PARTS, step)):
            if piece.any():
                yield pd.DataFrame([(part, lane, zlib.compress(_code(piece).tobytes(), 1))], columns=["part", "lane", "codes"])

    def add(pdf):
        total = np.zeros(step, dtype=np.float64)
        for blob in pdf["codes"]:
            total += _value(np.frombuffer(zlib.decompress(blob), np.uint8))
        return pd.DataFrame([(pdf["part"].iloc[0], int(pdf["lane"].iloc[0]) >> 5, zlib.compress(_code(total).tobytes(), 1))], columns=["part", "lane", "codes"])

    kind = "part INT, lane INT, codes BINARY"
    # merged in levels of 32 tasks, so that no merge holds the pieces of all tasks
    lanes = groups.mapInPandas(count, kind)
    for _ in range(2):
        lanes = lanes.groupBy("part", "lane").applyInPandas(add, kind)
    out = np.zeros((depth * PARTS, step), dtype=np.uint8)
    for row in lanes.groupBy("part").applyInPandas(add, kind).collect():
        out[row.part] = np.frombuffer(zlib.decompress(row.codes), np.uint8)
    return out.reshape(depth, 1 << bits)


def _held(codes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The sketch's count of each token: never less than the true one (up to saturation)."""
    bits = codes.shape[1].bit_length() - 1
    out = codes[0][_slots(tokens, bits, 0)]
    for row in range(1, len(codes)):
        out = np.minimum(out, codes[row][_slots(tokens, bits, row)])
    return out


def _code(counts: np.ndarray) -> np.ndarray:
    """Counts to bytes: themselves up to 127, then their logarithm."""
    c = counts.astype(np.float64)
    return np.where(c < 128, c, np.minimum(255, 128 + np.floor(6 * np.log2(np.maximum(c, 128) / 128)))).astype(np.uint8)


def _value(codes: np.ndarray) -> np.ndarray:
    c = codes.astype(np.float64)
    return np.where(c < 128, c, 128 * np.exp2((c - 128) / 6))


def _prefixes(batch: pd.DataFrame, codes: np.ndarray, threshold: float):
    """(token, group row, member size, tokens from here on, in the index prefix) of each probe prefix token worth a row."""
    parts = [_prefixes_of(batch.iloc[a : a + SLICE], codes, threshold, a) for a in range(0, len(batch), SLICE)]
    return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]


#: Groups handled at a time: their members are numbered in 16 bits beside a count and a token.
SLICE = (1 << 16) // 32


def _prefixes_of(batch: pd.DataFrame, codes: np.ndarray, threshold: float, first: int):
    tokens, member, sizes, rows = _members(batch)
    # one sort by member, then from rare to frequent, then by token
    key = np.sort((member.astype(np.uint64) << np.uint64(48)) | (_held(codes, tokens).astype(np.uint64) << _TOKEN_BITS) | tokens)
    tokens, df, member = key & np.uint64((1 << 40) - 1), (key >> _TOKEN_BITS).astype(np.uint8), (key >> np.uint64(48)).astype(np.int64)
    n = sizes[member]
    rank = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    probe = n - np.ceil(threshold * n - 1e-9) + SHARED
    index = n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9) + SHARED
    keep = (rank < probe) & (df > 1)
    member, n = member[keep], n[keep]
    return tokens[keep], rows[member] + first, n, n - rank[keep], (rank < index)[keep]


def _matrix(groups: DataFrame, codes, indexed, threshold: float) -> DataFrame:
    """Rows (tok, gid, idx, lo, hi, rest) of the union of each group's prefixes; ``idx`` where an index prefix holds the token.

    The index prefix is a part of the probe prefix, so that one row serves both sides of the join and the rows are
    shuffled once.
    """

    def run(batches):
        df, known = codes.value, indexed.value
        for batch in batches:
            tokens, row, n, rest, index = _prefixes(batch, df, threshold)
            use = index | (_held(known, tokens) > 0)
            t, r, m, s, x = tokens[use], row[use], n[use], rest[use], index[use]
            if not len(t):
                continue
            order = np.lexsort((t, r))
            t, r, m, s, x = t[order], r[order], m[order], s[order], x[order]
            first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (r[1:] != r[:-1])]))
            yield pd.DataFrame({
                "tok": t[first].view(np.int64), "gid": batch["gid"].to_numpy()[r[first]], "idx": np.logical_or.reduceat(x, first), "lo": np.minimum.reduceat(m, first).astype(np.int32),
                "hi": np.maximum.reduceat(m, first).astype(np.int32), "rest": np.maximum.reduceat(s, first).astype(np.int32),
            })

    return groups.select("gid", "sizes", "toks").mapInPandas(run, "tok BIGINT, gid BIGINT, idx BOOLEAN, lo INT, hi INT, rest INT")


def _similar(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Jaccard similarity where it reaches the threshold, else 0."""
    x, y = len(a), len(b)
    if min(x, y) < threshold * max(x, y) - 1e-9:
        return 0.0
    if x > y:
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return common / (x + y - common) if common * (1 + threshold) >= threshold * (x + y) - 1e-9 else 0.0


def _unfold(sizes, toks) -> list[np.ndarray]:
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64)) * 5
    return [unpack(toks[e - 5 * n : e]) for e, n in zip(ends, sizes)]


PAIRS = "a BIGINT, b BIGINT, similarity DOUBLE"


def member_pairs(groups: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of all pairs of members over the threshold; a member is gid * GROUP + its place."""
    sc = groups.sparkSession.sparkContext
    codes = sc.broadcast(_counted(groups.select("sizes", "toks"), lambda batch: _members(batch)[0], BITS, DEPTH))

    def index_tokens(batch):
        tokens, _, _, _, index = _prefixes(batch, codes.value, threshold)
        return tokens[index]

    indexed = sc.broadcast(_counted(groups.select("sizes", "toks"), index_tokens, INDEX_BITS))
    rows = _matrix(groups, codes, indexed, threshold)
    x, y = rows.alias("x"), rows.alias("y")

    def fits(short: str, long: str):
        # the shorter text has the token in its index prefix; sizes must allow the threshold
        return F.col(f"{short}.idx") & (F.col(f"{long}.hi") >= F.col(f"{short}.lo")) & (F.col(f"{short}.hi") >= threshold * F.col(f"{long}.lo") - 1e-9)

    met = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.gid") < F.col("y.gid")) & (fits("x", "y") | fits("y", "x")))
    bound = F.ceil(threshold / (1 + threshold) * (F.min("x.lo") + F.min("y.lo")) - 1e-9)
    shared = met.groupBy(F.col("x.gid").alias("g"), F.col("y.gid").alias("h")).agg(F.count("*").alias("n"), F.max(F.least("x.rest", "y.rest")).alias("rest"), bound.alias("bound"))
    qualified = shared.filter((F.col("n") >= F.least(F.lit(SHARED), F.col("bound"))) & (F.col("rest") >= F.col("bound"))).select("g", "h")
    qualified = materialise(qualified, "group-pairs")

    def within(batches):
        for batch in batches:
            out = []
            for gid, sizes, toks in zip(batch["gid"], batch["sizes"], batch["toks"]):
                sets = _unfold(sizes, toks)
                for (x, s), (y, t) in itertools.combinations(enumerate(sets), 2):
                    if sim := _similar(s, t, threshold):
                        out.append((gid * GROUP + x, gid * GROUP + y, sim))
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    def across(batches):
        for batch in batches:
            out = []
            for g, h, gs, gt, hs, ht in zip(batch["g"], batch["h"], batch["gs"], batch["gt"], batch["hs"], batch["ht"]):
                left, right = _unfold(gs, gt), _unfold(hs, ht)
                for x, s in enumerate(left):
                    for y, t in enumerate(right):
                        if sim := _similar(s, t, threshold):
                            out.append((g * GROUP + x, h * GROUP + y, sim))
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    involved = qualified.select("g").union(qualified.select("h")).distinct().withColumnRenamed("g", "gid")
    slim = groups.select("gid", "sizes", "toks").join(involved, "gid", "left_semi")
    opened = qualified.join(slim.select(F.col("gid").alias("g"), F.col("sizes").alias("gs"), F.col("toks").alias("gt")), "g")
    opened = opened.join(slim.select(F.col("gid").alias("h"), F.col("sizes").alias("hs"), F.col("toks").alias("ht")), "h")
    inner = groups.filter(F.size("sizes") > 1).select("gid", "sizes", "toks").mapInPandas(within, PAIRS)
    return inner.unionByName(opened.select("g", "h", "gs", "gt", "hs", "ht").mapInPandas(across, PAIRS))


def grouped(records: DataFrame, k: int) -> DataFrame:
    """Groups of (src, id, text) records, written to the shared folder."""
    return materialise(_groups(_sets(records.select("src", "id", "text").filter(F.col("text").isNotNull() & F.col("id").isNotNull()), k)), "groups")


def _listed(groups: DataFrame) -> DataFrame:
    """(member, src, ids) of every member."""
    place = groups.select("gid", "src", "ids", F.posexplode("counts").alias("place", "n"), F.col("counts").alias("counts"))
    start = F.aggregate(F.slice("counts", 1, F.col("place")), F.lit(0), lambda s, x: s + x)
    return place.select((F.col("gid") * GROUP + F.col("place")).alias("member"), "src", F.slice("ids", start + 1, F.col("n")).alias("ids"))


def members(groups: DataFrame) -> DataFrame:
    """(member, src, id) of every record that has tokens."""
    return _listed(groups).select("member", "src", F.explode("ids").alias("id"))


def record_pairs(records: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(src, id_a, id_b) of all pairs of records of a source with similarity of the threshold or more, id_a < id_b."""
    groups = grouped(records, k)
    pairs = member_pairs(groups, threshold)
    m = members(groups)
    a, b = m.select(F.col("member").alias("a"), "src", F.col("id").alias("x")), m.select(F.col("member").alias("b"), F.col("id").alias("y"))
    cross = pairs.select("a", "b").join(a, "a").join(b, "b").select("src", "x", "y")
    copies = _copies(groups)
    both = cross.unionByName(copies).filter(F.col("x") != F.col("y"))
    return both.select("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _copies(groups: DataFrame) -> DataFrame:
    """(src, x, y) of the records listed by one member. Lists meet in blocks of ``BLOCK`` ids, so that many copies of one text are spread over many tasks."""
    lists = _listed(groups.filter(F.exists("counts", lambda n: n > 1))).filter(F.size("ids") > 1)
    cut = lambda k: F.slice("ids", F.col(k) * BLOCK + 1, F.lit(BLOCK))
    blocks = F.sequence(F.lit(0), F.ceil(F.size("ids") / BLOCK).cast("int") - 1)
    met = lists.withColumn("i", F.explode(blocks)).withColumn("j", F.explode(F.sequence("i", F.ceil(F.size("ids") / BLOCK).cast("int") - 1)))
    met = met.select("member", "src", "i", "j", cut("i").alias("xs"), cut("j").alias("ys")).repartition("member", "i", "j")
    return met.select("src", F.explode("xs").alias("x"), "ys", "i", "j").select("src", "x", F.explode("ys").alias("y"), "i", "j").filter((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))).select("src", "x", "y")


def classes(records: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(src, id, class_id, n_links): each record once with its class (connected by links) and its text's links to other texts.

    Copies are not expanded into pairs. Labels are the least member of the class: each round takes the least label of a
    member's neighbours, then that label's own label, until nothing changes; rounds are cut by written tables.
    """
    groups = grouped(records, k)
    pairs = member_pairs(groups, threshold)
    # a text whose copies fill several members is one of them, so that it counts once and never as its own neighbour
    pairs = materialise(pairs.select("a", "b", (F.col("similarity") == 1).alias("same")), "member-pairs")
    edges = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "same")).distinct()
    labels = materialise(edges.select(F.col("a").alias("v")).distinct().withColumn("label", F.col("v")), "labels")
    before = labels
    while True:
        near = edges.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = step.select(F.col("v").alias("label"), F.col("label").alias("upper"))
        step = materialise(step.join(up, "label", "left").select("v", "old", F.least("label", F.coalesce("upper", "label")).alias("label")), "labels")
        discard(before)
        labels, before = step.select("v", "label"), step
        if step.filter(F.col("old") != F.col("label")).isEmpty():
            break
    # equal sets are all linked with each other, so that the least neighbour of that kind is the same for all of them
    first = edges.filter("same").groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("text"))
    a, b = first.select(F.col("v").alias("a"), F.col("text").alias("at")), first.select(F.col("v").alias("b"), F.col("text").alias("bt"))
    texts = edges.filter(~F.col("same")).join(a, "a", "left").join(b, "b", "left").select(F.coalesce("at", "a").alias("text"), F.coalesce("bt", "b").alias("other")).distinct()
    links = texts.groupBy("text").agg(F.count("*").alias("n_links"))
    out = members(groups).join(labels.withColumnRenamed("v", "member"), "member", "left").join(first.select(F.col("v").alias("member"), "text"), "member", "left")
    out = out.withColumn("text", F.coalesce("text", "member")).join(links, "text", "left")
    out = out.select("src", "id", F.coalesce("label", "member").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    named = out.groupBy("class_id", "src").agg(F.min("id").alias("name"))
    return out.join(named, ["class_id", "src"]).groupBy("src", "id").agg(F.min("name").alias("class_id"), F.max("n_links").alias("n_links"))
