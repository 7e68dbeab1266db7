"""N-gram Jaccard join: all pairs of documents whose sets of word shingles are alike, as connected components.

The method is a prefix filter with token combinations. Tokens (shingles) are ordered by document frequency. If two sets
overlap enough, few tokens of either prefix are missing from the other set; with n_1 rare tokens and n_g frequent ones in
class g in the prefix, and sum(n_1 + sum over g of max(0, n_g - 1)) above the number that may be missing, the two share a
rare token or two frequent tokens of one class. So rare tokens are indexed alone, and frequent tokens, for which the prefix
is extended, in pairs within a class; classes are finer for larger sets, by bands of set sizes.

1. Documents with equal sets are one class with one representative.
2. Frequencies of all shingles are counted by chunks and buckets (see counts). Tokens of frequency 1 match nothing, so most
   documents need no index entry; the others keep their shared tokens under dense numbers.
3. In each index list all members are verified against the smallest; components of these links are found at once or, if
   there are many, by alternating large and small stars. Who is not in a list's largest component then is verified against one of its members, and who
   is still outside against all members of other components, so no link between components is missed; links within a
   component add nothing and are not looked for.

Defined results: a set of fewer than 5 words is the whole sequence; empty and null texts have no set and are components of
their own; a null id has no component id; repeated rows are alike; other columns are dropped. 64-bit hashes stand for
shingles. Nothing of the documents goes to the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import counts as C
from tidemark.llm.common import cut, mix, pick, texts_in, word_hashes

WORDS = 5
PERCENT = 75
#: Tokens in more documents than this are frequent: they are indexed in pairs.
RARE = 64
#: Members and askers of a cluster in a block.
MEMBERS, ASKERS = 256, 64
#: Links between documents that a task joins to components at once; more are joined in rounds.
AT_ONCE = 250_000
#: Entries of a set that tell which list of several in common is the first.
FIRST = 16
_STEPS = mix(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)
_OTHER = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """For runs of texts: (row, token) of the distinct shingles, by row and token, and the first and end row."""
    for i, j, data, starts, ends in texts_in(column):
        h, row = word_hashes(data, starts, ends)
        n = np.bincount(row, minlength=j - i)
        tokens = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            tokens += h[k : len(h) - WORDS + 1 + k] * _STEPS[k]
        rows = row[: len(tokens)]
        whole = rows == row[WORDS - 1 :]
        tokens, rows = mix(tokens[whole]), rows[whole]
        short = np.flatnonzero((n > 0) & (n < WORDS))
        if len(short):
            first = np.concatenate([[0], np.cumsum(n)])
            own = np.array([mix(np.add.reduce(h[first[r] : first[r + 1]] * _STEPS[: n[r]], dtype=np.uint64, keepdims=True) + np.uint64(n[r]))[0] for r in short], np.uint64)
            tokens, rows = np.concatenate([tokens, own]), np.concatenate([rows, short])
        order = np.lexsort((tokens, rows))
        tokens, rows = tokens[order], rows[order]
        keep = np.ones(len(tokens), bool)
        keep[1:] = (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1])
        yield rows[keep] + i, tokens[keep], i, j


def _class_keys(rows: np.ndarray, tokens: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The size of each set, and a hash of it that does not depend on the order."""
    n = np.bincount(rows - i, minlength=j - i).astype(np.int64)
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix(tokens ^ _OTHER), out=sums[1:])
    at = np.concatenate([[0], np.cumsum(n)])
    return n, mix((sums[at[1:]] - sums[at[:-1]]) ^ (n.astype(np.uint64) * _OTHER)).view(np.int64)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for found in shingle_sets(batch.column("text")):
            a, b = _class_keys(*found)
            n.append(a)
            key.append(b)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(n)), pa.array(np.concatenate(key))], names=["id", "n", "c"])


def _representatives(docs: pa.Table, reps: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the documents of a chunk, one for each class: class keys, sizes, ends, tokens."""
    docs = docs.filter(pc.is_in(docs.column("id"), pa.array(reps, docs.schema.field("id").type)))
    seen: set[int] = set()
    ids = docs.column("id").to_pylist()
    for rows, tokens, i, j in shingle_sets(docs.column("text")):
        n, key = _class_keys(rows, tokens, i, j)
        ends = np.cumsum(n)
        keep = []
        for k in range(j - i):
            c = int(key[k])
            if c in reps[ids[i + k]] and c not in seen:
                seen.add(c)
                keep.append(k)
        if keep:
            mine = np.repeat(np.isin(np.arange(j - i), keep), n)
            yield key[keep], n[keep], np.cumsum(n[keep]), tokens[mine]


def _by_id(table: pa.Table) -> dict:
    reps: dict = {}
    for i, c in zip(table.column("id").to_pylist(), table.column("c").to_pylist(), strict=True):
        reps.setdefault(i, set()).add(c)
    return reps


def must_share(n):
    """The least overlap of a set of n tokens with any set that it links with."""
    return (PERCENT * n + 99) // 100


def band(n: int) -> int:
    """Sets that link are in the same band or in adjacent ones."""
    return int(np.log(n) / np.log(100 / PERCENT) + 1e-9)


def prefix_entries(n: int, alone: int, frequency: np.ndarray, tokens: np.ndarray, rare: int = RARE) -> np.ndarray | None:
    """Index entries of a set of n tokens, of which ``alone`` are in no other set; the others by (frequency, token).

    None if no other set can link with it. Frequent tokens are dealt into classes by their number, in as many classes as
    suit the band of the set's size, once for its own band and once for the next, so that any two sets that link have a
    band in common.
    """
    missing = n - must_share(n)
    if alone > missing:
        return None
    need = missing + 1 - alone
    few = int(np.searchsorted(frequency, rare, side="right"))
    single = mix(tokens[: min(need, few)].astype(np.uint64))
    if few >= need:
        return single
    need -= few
    out = [single]
    often = tokens[few:].astype(np.uint64)
    for b in (band(n), band(n) + 1):
        classes = max(1, int((100 / PERCENT) ** b) // 12)
        group = (mix(often) % np.uint64(classes)).astype(np.int64)
        # The prefix ends where the tokens beyond the first of each class are enough.
        first = np.zeros(len(often), bool)
        first[np.unique(group, return_index=True)[1]] = True
        enough = np.flatnonzero(np.cumsum(~first) >= need)
        end = int(enough[0]) + 1 if len(enough) else len(often)
        salt = mix(np.array([b + 7], np.uint64))[0]
        order = np.argsort(group[:end], kind="stable")
        t, g = often[:end][order], group[:end][order]
        for gap in range(1, end):
            same = g[gap:] == g[:-gap]
            if not same.any():
                break
            x, y = np.minimum(t[gap:][same], t[:-gap][same]), np.maximum(t[gap:][same], t[:-gap][same])
            out.append(mix(mix(x ^ salt) + y * _OTHER))
    return np.unique(np.concatenate(out))


def pack_tokens(tokens: np.ndarray) -> bytes:
    return C.pack_keys(np.sort(tokens.astype(np.uint64)))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their sizes and packed tokens to the pairs that link."""
    for batch in batches:
        cache: dict[int, np.ndarray] = {}
        keep = []
        columns = [batch.column(x) for x in ("u", "v", "nu", "nv", "tu", "tv")]
        for k in range(batch.num_rows):
            u, v, nu, nv = (c[k].as_py() for c in columns[:4])
            if len(cache) > 2000:
                cache.clear()
            for x, c in ((u, columns[4]), (v, columns[5])):
                if x not in cache:
                    cache[x] = C.unpack_keys(c[k].as_py())
            shared = len(np.intersect1d(cache[u], cache[v], assume_unique=True))
            keep.append(100 * shared >= PERCENT * (nu + nv - shared))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def could_link(u: Column, v: Column) -> Column:
    """Whether sizes allow a link: the overlap has to be at least PERCENT / (100 + PERCENT) of both sizes together, and
    is at most the number of tokens that either shares with any other set."""
    return (F.least(u["n"], v["n"]) * 100 >= F.greatest(u["n"], v["n"]) * PERCENT) & (F.least(u["m"], v["m"]) * (100 + PERCENT) >= (u["n"] + v["n"]) * PERCENT)


def _within_clusters(asked: DataFrame, members: DataFrame, tokens: DataFrame) -> DataFrame:
    """Askers (v, rv, cluster) and members (x, root, cluster) to a link (u, v) for each asker, block of members of its
    cluster and other component.

    Askers and members meet in blocks, so that the pairs are never rows. Blocks are of one band of sizes, and an asker goes
    to those of its own and the adjacent bands; each block of members is a key of its own, so a large cluster is many.
    """
    tokens = tokens.select(F.col("c").alias("_c"), "tokens")
    band_of = lambda n: F.floor(F.ln(n) / F.ln(F.lit(100 / PERCENT)) + 1e-9)

    def packed(rows: DataFrame, x: str, root: str, block: Column, name: str, *more: Column) -> DataFrame:
        full = rows.join(tokens, F.col(f"{x}.c") == F.col("_c")).withColumn("_b", F.pmod(F.xxhash64(F.col(f"{x}.c")), block))
        return full.groupBy("cluster", "band", "_b").agg(F.collect_list(F.struct(f"{x}.c", f"{x}.n", f"{x}.m", F.col(root).alias("root"), "tokens")).alias(name), *more)

    members = members.join(asked.select("cluster").distinct(), "cluster", "left_semi").withColumn("band", band_of(F.col("x.n")))
    blocks = members.groupBy("cluster", "band").agg(F.ceil(F.count("*") / MEMBERS).alias("blocks"))
    own = band_of(F.col("v.n"))
    asked = asked.withColumn("band", F.explode(F.array(own - 1, own, own + 1))).join(blocks, ["cluster", "band"])
    asked = asked.join(asked.groupBy("cluster", "band").agg(F.ceil(F.count("*") / ASKERS).alias("parts")), ["cluster", "band"])
    askers = packed(asked, "v", "rv", F.col("parts"), "askers", F.first("blocks").alias("blocks")).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = askers.join(packed(members.join(blocks, ["cluster", "band"]), "x", "root", F.col("blocks"), "members"), ["cluster", "band", "_b"])
    return met.select("askers", "members").mapInArrow(_block_links, "u long, v long")


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for askers, members in zip(batch.column("askers"), batch.column("members"), strict=True):
            us, vs = [], []
            members = members.as_py()
            keys = [C.unpack_keys(x["tokens"]) for x in members]
            n, m, root = (np.array([x[k] for x in members], np.int64) for k in ("n", "m", "root"))
            length = np.array([len(k) for k in keys])
            at = np.concatenate([[0], np.cumsum(length)[:-1]])
            joined = np.concatenate(keys)
            for v in askers.as_py():
                mine = C.unpack_keys(v["tokens"])
                fits = (root != v["root"]) & (np.minimum(n, v["n"]) * 100 >= np.maximum(n, v["n"]) * PERCENT) & (np.minimum(m, v["m"]) * (100 + PERCENT) >= (n + v["n"]) * PERCENT)
                if not fits.any():
                    continue
                place = np.minimum(np.searchsorted(mine, joined), len(mine) - 1)
                shared = np.add.reduceat((mine[place] == joined).astype(np.int64), at)
                linked = np.flatnonzero(fits & (100 * shared >= PERCENT * (n + v["n"] - shared)))
                for k in linked[np.unique(root[linked], return_index=True)[1]]:
                    us.append(members[k]["c"])
                    vs.append(v["c"])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links to (node, root), by union-find."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = top(u), top(v)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(links: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(u, v) to (node, root) of every node in a link; the root is the smallest node of the component.

    Up to ``at_once`` different links are joined in one task; more by alternating large and small stars, with a plan and an
    intermediate table a round.
    """
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    if before[0] <= at_once:
        return cut(edges.coalesce(1).mapInArrow(_rooted, "node long, root long"))
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(small.select(F.col("u"), F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, chunk_text: int = C.CHUNK_TEXT, bucket_keys: int = C.BUCKET_KEYS) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id (the smallest id of its component), class_size (equal sets)."""
    docs = pick(df, id=id_col, text=text_col)
    kind = docs.schema["id"].dataType.simpleString()
    sets = cut(docs.mapInArrow(_classes, f"id {kind}, n long, c long"))
    classes = sets.where("n > 0 and id is not null").groupBy("c").agg(F.min("id").alias("least_id"), F.count("*").alias("class_size"), F.first("n").alias("n"))
    size = C.text_bytes(docs)[0]
    chunks, buckets = C.parts(size, chunk_text), C.parts(size // 6, bucket_keys)
    reps = cut(classes.select(C.dealt(chunks, "least_id").alias("chunk"), F.col("least_id").alias("id"), "c"))
    # Rows without an id have no part in components, so they do not gather under one key.
    texts = docs.where("id is not null").withColumn("chunk", C.dealt(chunks, "id"))

    def forward(key, docs, reps):
        found = [t for _, _, _, t in _representatives(docs, _by_id(reps))]
        return C.sent(key[0].as_py(), *np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True), buckets)

    def total(table: pa.Table) -> pa.Table:
        chunks, lengths, distinct, place, count = C.received(table)
        frequency = np.bincount(place, weights=count).astype(np.int64)
        shared = frequency > 1
        number = np.cumsum(shared) - 1 + (int(table.column("bucket")[0].as_py()) << 32)
        answers, at = [], 0
        for n in lengths:
            p = place[at : at + n]
            f = frequency[p]
            packed = C.pack_counts(f)
            answers.append(len(packed).to_bytes(8, "little") + packed + number[p][f > 1].astype("<u8").tobytes())
            at += n
        return pa.table([pa.array(chunks, pa.int64()), pa.array([table.column("bucket")[0].as_py()] * len(chunks), pa.int32()), pa.array(answers, pa.binary())], names=["chunk", "bucket", "answer"])

    answers = texts.groupBy("chunk").cogroup(reps.groupBy("chunk")).applyInArrow(forward, C.SENT).groupBy("bucket").applyInArrow(total, C.ANSWER)
    # The representatives' ids go with the answers, as what a chunk gets must come from one side.
    back = cut(answers.select("chunk", "bucket", "answer", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("long").alias("c")).union(reps.select("chunk", F.lit(-1), F.lit(None), "id", "c")))

    def indexed(key, docs, back):
        is_rep = pc.equal(back.column("bucket"), -1)
        found = list(_representatives(docs, _by_id(back.filter(is_rep))))
        frequency, number = [], []
        for _, a in C.in_order(back.filter(pc.invert(is_rep))):
            n = int.from_bytes(a[:8], "little")
            f = C.unpack_counts(a[8 : 8 + n])
            x = np.zeros(len(f), np.int64)
            x[f > 1] = np.frombuffer(a, "<u8", offset=8 + n).astype(np.int64)
            frequency.append(f)
            number.append(x)
        out: tuple[list, ...] = ([], [], [], [], [])
        if found:
            place = np.unique(np.concatenate([t for *_, t in found]), return_inverse=True)[1]
            f, x = np.concatenate(frequency)[place], np.concatenate(number)[place]
            at = 0
            for c, n in zip(np.concatenate([k for k, *_ in found]).tolist(), np.concatenate([k for _, k, *_ in found]).tolist(), strict=True):
                mine, own = f[at : at + n], x[at : at + n]
                at += n
                alone = int((mine == 1).sum())
                if alone > n - must_share(n):
                    continue
                order = np.lexsort((own[mine > 1], mine[mine > 1]))
                own = own[mine > 1][order]
                entries = prefix_entries(n, alone, mine[mine > 1][order], own, rare)
                for column, value in zip(out, (c, n, len(own), pack_tokens(own), np.sort(entries.view(np.int64))), strict=True):
                    column.append(value)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.list_(pa.int64()))], names=["c", "n", "m", "tokens", "entries"])

    index = cut(texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(indexed, "c long, n long, m long, tokens binary, entries array<long>"))
    item = lambda c, n, m: F.struct(F.col(c).alias("c"), F.col(n).alias("n"), F.col(m).alias("m"))
    lists = index.select("c", "n", "m", F.explode("entries").alias("e"))
    # Lists of one member hold no pair.
    lists = cut(lists.join(lists.groupBy("e").agg(F.min(item("c", "n", "m")).alias("hub"), F.count("*").alias("members")).where("members > 1"), "e"))
    tokens = index.select("c", "n", "tokens")

    def verified(pairs: DataFrame) -> DataFrame:
        """(u, v) as structs of key, size and shared tokens to the pairs that link."""
        close = pairs.where(could_link(F.col("u"), F.col("v"))).select(F.least("u.c", "v.c").alias("u"), F.greatest("u.c", "v.c").alias("v")).distinct()
        full = close.join(tokens.select(F.col("c").alias("u"), F.col("n").alias("nu"), F.col("tokens").alias("tu")), "u").join(tokens.select(F.col("c").alias("v"), F.col("n").alias("nv"), F.col("tokens").alias("tv")), "v")
        return cut(full.mapInArrow(_links, "u long, v long"))

    def rooted_by(links: DataFrame) -> DataFrame:
        """The index lists with the members' components, of those that have several, and the largest of each."""
        placed = lists.join(links.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        sizes = placed.groupBy("e", "root").agg(F.count("*").alias("k"), F.max_by(item("c", "n", "m"), F.xxhash64("c", "e")).alias("some"))
        largest = sizes.groupBy("e").agg(F.max_by(F.struct("root", "some"), F.struct("k", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1")
        return cut(placed.join(largest, "e").select("e", item("c", "n", "m").alias("x"), "root", "members", "largest"))

    def with_edges(more: DataFrame, rooted: DataFrame) -> DataFrame:
        return components(more.union(rooted.select(F.col("node").alias("u"), F.col("root").alias("v")))) if more.take(1) else rooted

    outside = F.col("root") != F.col("largest.root")
    # Against the smallest member of each list.
    rooted = components(verified(lists.where("c <> hub.c").select(F.col("hub").alias("u"), item("c", "n", "m").alias("v"))))
    # Who is not in the list's largest component yet, against one of its members, another in each list.
    rooted = with_edges(verified(rooted_by(rooted).where(outside).select(F.col("largest.some").alias("u"), F.col("x").alias("v"))), rooted)
    # Who is still outside, against all members of other components: those of the shared lists, or, if these are fewer,
    # all that shared lists connect. Either way all pairs that could link are there.
    still = rooted_by(rooted)
    few = still.where(outside).select("e", F.col("x").alias("v"), F.col("root").alias("rv"), "members")
    reach = components(still.groupBy("e").agg(F.min("x.c").alias("u")).join(still.select("e", F.col("x.c").alias("v")), "e").select("u", "v"))
    sizes = reach.groupBy(F.col("root").alias("cluster")).agg(F.count("*").alias("size"))
    clustered = still.select("x", "root").distinct().join(reach.select(F.col("node").alias("_n"), F.col("root").alias("cluster")), F.col("x.c") == F.col("_n")).drop("_n").join(sizes, "cluster")
    costs = few.groupBy("v", "rv").agg(F.sum("members").alias("by_lists")).join(clustered.select(F.col("x").alias("v"), "cluster", "size"), "v")
    costs = cut(costs.select("v", "rv", "cluster", (F.col("by_lists") <= F.col("size")).alias("lists")))
    # A pair comes from the first list that both are in, as far as the first entries tell.
    first = index.select("c", F.slice("entries", 1, FIRST).alias("first"))
    known = lambda rows, x: rows.join(first.withColumnRenamed("c", "_c"), F.col(f"{x}.c") == F.col("_c")).drop("_c")
    a = known(few.join(costs.where("lists").select("v"), "v"), "v").select("e", "v", "rv", F.filter("first", lambda y: y < F.col("e")).alias("fv"))
    b = known(still.select("e", F.col("x").alias("u"), F.col("root").alias("ru")), "u").select("e", "u", "ru", F.filter("first", lambda y: y < F.col("e")).alias("fu"))
    listed = a.join(b, (a["e"] == b["e"]) & (F.col("ru") != F.col("rv")) & could_link(F.col("u"), F.col("v")) & ~F.arrays_overlap("fu", "fv")).select("u", "v")
    more = verified(listed).union(_within_clusters(costs.where("not lists"), clustered, tokens))
    rooted = with_edges(cut(more), rooted)
    linked = classes.join(rooted.select(F.col("node").alias("c"), "root"), "c").select("c", "root", "least_id")
    smallest = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = linked.join(smallest, "root").select("c", "component_id")
    ids = classes.join(found, "c", "left").select("c", "class_size", F.coalesce("component_id", "least_id").alias("component_id"))
    return (
        sets.join(ids, "c", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id")).alias("component_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))
    )
