r"""Similarity join of texts on their word n-grams, with prefixes of token combinations.

Tokens are distinct word n-grams. A global order puts rare tokens first, then the most frequent ones by count; of two similar sets the
prefixes in this order must overlap. Rare tokens are indexed one by one. Frequent tokens are dealt into classes by hash, prefixes are
extended by one token per class, and pairs of tokens of a class are indexed: sharing fewer than two in every class would already mean
more foreign tokens than similar sets may have. The number of classes follows the size of a set, and a set near a step is indexed for both
sides of it, so any two similar sets share a signature.

Equal sets are one set first. Of the sets that share a signature each is held against one of them, the hub: first bounds on sizes and on the
overlap of prefixes, then whole texts. Links make components. Two sets of one hub that are similar to each other, but not yet in one
component, either share enough with the hub itself, which fixes their sizes, or share a token that the hub has not: such tokens, rarest
first, are the signatures of the next round, with hubs of their own. After ``rounds`` rounds, or when no signature holds two components,
the few pairs left are compared directly; so are pairs of which the bounds had kept one from the hub. A group of copies never expands
into its pairs, yet no link between components is missed.

The list of frequent tokens is the ``FREQUENT`` most frequent by counts over all documents (of tokens that repeat within some ``CHUNK``
tokens); it only orders tokens, results do not depend on it. Null and empty texts have no tokens and link with nothing; a text of fewer
words than n is one token; rows that share an id are compared as texts of their own; null ids get the component of their set and cannot name
one; an empty table gives an empty result. Tokens and texts of one id are told apart by 64-bit hashes.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from gavelwork.llm.common import bounded_batches, one_row_per, repeated_ids, sliced, stored, text_hash, without
from gavelwork.llm.components import components

FREQUENT = 500_000
CHUNK = 1_500_000
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(h):
    """Spreads 64-bit numbers (modular arithmetic)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


_POWERS = {}


def _powers(n):
    have = _POWERS.get("p")
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 19)
        have = _POWERS["p"] = tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, m, np.uint64)))) for m in (MULTIPLIER, INVERSE))
    return have


def word_hashes(data):
    """(hash, first byte) of every word of a byte string: polynomials taken from running sums, one pass for all words."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = np.concatenate(([False], ~BLANK[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def token_sets(texts, width):
    """Sorted distinct tokens (int64) of every text: hashes of ``width`` words in a row of the text in lower-case ASCII."""
    out, held, size = [], [], 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass").lower() if t else b""
        held.append(b)
        size += len(b) + 1
        if size > 250_000:
            out += _token_sets(held, width)
            held, size = [], 0
    return out + _token_sets(held, width)


def _token_sets(texts, width):
    if not texts:
        return []
    words, start = word_hashes(b" ".join(texts))
    firsts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    cut = np.searchsorted(start, firsts)
    h = words.copy()
    m = len(words) - width + 1
    if m > 0:
        h = words[:m]
        for k in range(1, width):
            h = mix(h) + words[k : k + m] * np.uint64(2 * k + 1)
        h = mix(h)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1].view(np.int64)))
        elif b > a:
            s = np.array([b - a], np.uint64)
            for k in range(a, b):
                s = mix(s) + words[k : k + 1]
            out.append(mix(s).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out


def _local_counts(width):
    """Tokens that repeat in a chunk of documents, equal sets counted once there, with their counts."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held, seen, size = [], set(), 0

        def counted():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            at = n > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[at]), pa.array(n[at])], schema=schema)

        for b in sliced(batches):
            for s in token_sets(b.column(0).to_pylist(), width):
                key = hashlib.blake2b(s.tobytes(), digest_size=8).digest()
                if key not in seen:
                    seen.add(key)
                    held.append(s)
                    size += len(s)
                if size > CHUNK:
                    yield counted()
                    held, seen, size = [], set(), 0
        if held:
            yield counted()

    return run


def frequent_tokens(docs, width):
    """(tokens, counts) of the most frequent tokens, sorted by token."""
    counts = docs.select("text").mapInArrow(_local_counts(width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens, n = top.column("token").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def _levels(n, percent):
    top = [int(np.log2(max(1, x)) // 2) for x in (n, max(1, n * percent // 100))]
    return sorted(set(top))


def signatures(tokens, frequent, counts, percent):
    """(signatures, plain): plain ones are the least rare tokens themselves; sets that only equal sets resemble have none."""
    n = len(tokens)
    if n * (100 - percent) < percent:
        return np.empty(0, np.int64), False
    need = n * (100 - percent) // 100 + 1
    at = np.minimum(np.searchsorted(frequent, tokens), max(0, len(frequent) - 1))
    often = frequent[at] == tokens if len(frequent) else np.zeros(n, bool)
    rare = tokens[~often]
    if len(rare) >= need:
        return rare[:need], True
    out, common = [rare], tokens[often][np.lexsort((tokens[often], counts[at[often]]))]
    hashed = mix(common.view(np.uint64))
    for level in _levels(n, percent):
        classes = max(1, 4**level // 8)
        cls = (hashed % np.uint64(classes)).astype(np.int64)
        gain = np.ones(len(cls), bool)
        gain[np.unique(cls, return_index=True)[1]] = False
        stop = int(np.searchsorted(np.cumsum(gain), need - len(rare))) + 1
        order = np.argsort(cls[:stop], kind="stable")
        c, h = cls[:stop][order], hashed[:stop][order]
        for d in range(1, stop):
            same = np.flatnonzero(c[:-d] == c[d:])
            if not len(same):
                break
            a, b = np.minimum(h[same], h[same + d]), np.maximum(h[same], h[same + d])
            out.append(mix(mix(a + np.uint64(level + 1)) + b * np.uint64(3)).view(np.int64))
    return np.concatenate(out), False


def _describe(width, percent, frequent):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("plain", pa.bool_()), ("sigs", pa.list_(pa.int64())), ("id", pa.int64()), ("th", pa.int64())])

    def run(batches):
        tokens, counts = frequent.value
        for b in sliced(batches):
            sets = token_sets(b.column(1).to_pylist(), width)
            got = [signatures(s, tokens, counts, percent) for s in sets]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x, _ in got]))).astype(np.int32)
            flat = np.concatenate([x for x, _ in got]) if got else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([p for _, p in got], pa.bool_()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), b.column(2), b.column(3)], schema=schema)

    return run


def _compare(width, percent, frequent):
    """Overlap of the texts of every pair, and the tokens of a that b has not, rarest first, as far as a similar third set must share one."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("both", pa.int64()), ("own", pa.list_(pa.int64()))])

    def run(batches):
        tokens, counts = frequent.value
        last, other = None, None
        for batch in sliced(batches):
            sets, rows = token_sets(batch.column(2).to_pylist(), width), []
            for a, b, s, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets, batch.column(3)):
                if b != last:
                    last, other = b, token_sets([text.as_py()], width)[0]
                at = np.minimum(np.searchsorted(other, s), max(0, len(other) - 1))
                shared = other[at] == s if len(other) else np.zeros(len(s), bool)
                own = s[~shared]
                k = np.minimum(np.searchsorted(tokens, own), max(0, len(tokens) - 1))
                often = np.where(tokens[k] == own, counts[k], 0) if len(tokens) else np.zeros(len(own), np.int64)
                rows.append((a, b, len(s), len(other), int(shared.sum()), own[np.lexsort((own, often))][: len(s) * (100 - percent) // 100 + 1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

    return run


def _compared(pairs, docs, width, percent, frequent, hint="auto"):
    """(a, b, na, nb, both, own) of pairs (a, b), from whole texts; many pairs may share b. ``hint``: how the texts are joined."""
    text = docs.select(F.col("doc_id").alias("d"), "text")
    text = text if hint == "auto" else text.hint(hint)
    left = pairs.join(text, F.col("a") == F.col("d")).select("a", "b", "text")
    right = pairs.select("b").distinct().join(text, F.col("b") == F.col("d")).select(F.col("b").alias("h"), F.col("text").alias("hub_text"))
    joined = left.join(right, F.col("b") == F.col("h")).select("a", "b", "text", "hub_text")
    return stored(joined.mapInArrow(_compare(width, percent, frequent), "a long, b long, na long, nb long, both long, own array<long>"), "compared")


def _possible(pairs, sets, percent):
    """Pairs (a, b) whose sizes allow the similarity, and whose prefixes do where both hold all rare tokens up to their last."""
    part = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n").alias("n" + c), F.col("plain").alias("p" + c), F.col("sigs").alias("s" + c))
    p = pairs.join(part("a"), "a").join(part("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    p = p.withColumns({"end": F.least(F.element_at("sa", -1), F.element_at("sb", -1)), "both": F.size(F.array_intersect("sa", "sb"))})
    upto = lambda c: F.size(F.filter(c, lambda t: t <= F.col("end")))
    most = F.col("both") + F.least(F.col("na") - upto("sa"), F.col("nb") - upto("sb"))
    return p.where(~(F.col("pa") & F.col("pb")) | ((100 + percent) * most >= percent * (F.col("na") + F.col("nb")))).select("a", "b")


def _beside_hub(members, asked, roots, percent):
    """Pairs of one signature of which the hub's comparison says nothing, because bounds had ruled out one of the two beside it."""
    known = asked.select(F.col("a").alias("ka"), F.col("b").alias("kb"))
    rows = members.where("doc <> hub AND m > 2").join(known, (F.col("doc") == F.col("ka")) & (F.col("hub") == F.col("kb")), "left")
    rows = rows.join(roots, F.col("doc") == F.col("node"), "left").select("sig", "doc", "n", F.col("ka").isNull().alias("ruled_out"), F.coalesce("root", "doc").alias("root"))
    rows = stored(rows, "beside")
    x, y = (rows.select("sig", F.col("doc").alias(d), F.col("root").alias("r" + d), F.col("n").alias("n" + d), F.col("ruled_out").alias("o" + d)) for d in "xy")
    alike = "rx <> ry AND (NOT oy OR x > y)"
    both = x.where("ox").join(y, "sig").where(F.expr(alike) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")))
    return both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _hub_pairs(members):
    """(doc, hub) for rows (sig, doc): the hub of a signature is its least document."""
    rows = members.withColumn("hub", F.min("doc").over(Window.partitionBy("sig")))
    return rows.where("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct()


def _band(n):
    """Sizes in steps of two per cent."""
    return F.floor(F.log(F.greatest(n, F.lit(1))) * 50).cast("long")


def _still_open(seen, roots, percent):
    """What compared documents of one hub may still have in common: ((sig, doc, root, n) rows, (a, b) pairs).

    Two documents similar to each other share no less than their least overlap with the hub, or tokens that the hub has not. The latter
    make signatures: per band of partners' sizes among the hub's documents as many, rarest first, as the least overlap leaves. The former
    fixes the sizes of a partner, and is met band by band.
    """
    of = lambda c, r: roots.select(F.col("node").alias(c + "_node"), F.col("root").alias(r))
    g = seen.join(of("a", "ra"), F.col("a") == F.col("a_node"), "left").join(of("b", "rb"), F.col("b") == F.col("b_node"), "left")
    g = g.select("a", "b", "na", "both", "own", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"), _band(F.col("na")).alias("band"))
    g = stored(g, "placed")
    mixed = stored(g.groupBy("b").agg(F.min("ra").alias("lo"), F.max("ra").alias("hi")).where("lo <> hi").select("b"), "mixed")
    g = g.join(mixed, "b", "left_semi")
    # per band of sizes that documents of other components have: what they share with the hub at most, so what they must share beside it
    sizes = g.groupBy("b", "band").agg(F.min("na").alias("lo"), F.max("both").alias("share"), F.min("ra").alias("r0"), F.max("ra").alias("r1"))
    sizes = sizes.select(F.col("b").alias("hub"), F.col("band").alias("t"), "lo", "share", "r0", "r1")
    fits = g.withColumn("theirs", F.explode(F.sequence(_band(F.ceil(F.col("na") * percent / 100)), _band(F.floor(F.col("na") * 100 / percent)))))
    fits = fits.join(sizes, (F.col("b") == F.col("hub")) & (F.col("theirs") == F.col("t"))).where("r0 <> ra OR r1 <> ra")
    overlap = F.ceil(percent * (F.col("na") + F.greatest("lo", F.ceil(F.col("na") * percent / 100))) / (100 + percent))
    need = F.col("na") - F.col("both") - overlap + F.least("both", "share") + 1
    rows = fits.where(need > 0).select("b", "band", "theirs", "a", "ra", "na", F.explode(F.slice("own", F.lit(1), need.cast("int"))).alias("token"))
    sig = F.xxhash64("b", F.least("band", "theirs"), F.greatest("band", "theirs"), "token")
    rows = stored(rows.select(sig.alias("sig"), F.col("a").alias("doc"), F.col("ra").alias("root"), F.col("na").alias("n")), "own")
    several = stored(rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig"), "several")
    members = rows.join(several, "sig", "left_semi")
    most = F.floor(F.col("both") * (100 + percent) / percent).cast("long") - F.col("na")
    least = F.ceil(F.col("na") * percent / 100)
    out = g.where((F.col("ra") != F.col("rb")) & (most >= least)).select("b", F.col("a").alias("x"), F.col("na").alias("nx"), F.col("ra").alias("rx"), most.alias("most"), least.alias("least"))
    out = out.withColumn("band", F.explode(F.sequence(_band(F.col("least")), _band(F.col("most")))))
    y = g.select("b", F.col("a").alias("y"), F.col("na").alias("ny"), F.col("ra").alias("ry"), most.alias("ymost"), "band")
    near = out.join(y, ["b", "band"]).where("x <> y AND rx <> ry AND ny BETWEEN least AND most AND nx <= ymost")
    return members, near.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _all_pairs(members, percent):
    """Pairs of different components that share a signature: what is left when most of a group is one component."""
    x, y = (members.select("sig", F.col("doc").alias(d), F.col("root").alias("r" + d), F.col("n").alias("n" + d)) for d in "ab")
    alike = (F.col("a") > F.col("b")) & (F.col("ra") != F.col("rb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return x.join(y, "sig").where(alike).select("a", "b").distinct()


def _numbered(docs):
    """doc_id, th, doc, text: ``doc`` is the id, or a number of its own below zero for rows that share an id; and the repeated ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("th"))
    twice = repeated_ids(docs)
    own = -1 - F.shiftrightunsigned(F.xxhash64("doc_id", "th"), 2)
    rows = docs.join(twice, F.col("doc_id") == F.col("_id"), "left")
    return rows.select("doc_id", "th", F.when(F.col("_id").isNull(), F.col("doc_id")).otherwise(own).alias("doc"), "text"), twice


def grouped(docs, width=4, percent=85, rounds=3):
    """doc_id, th (hash of the text), n_shingles, root (a number of the component) and component_id of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    rows, twice = _numbered(docs)
    texts = rows.select(F.col("doc").alias("doc_id"), "text")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(texts, width))
    schema = "doc_id long, n long, key binary, plain boolean, sigs array<long>, id long, th long"
    sets = stored(rows.select("doc", "text", "doc_id", "th").mapInArrow(_describe(width, percent, frequent), schema), "sets")
    equal = stored(sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("id").alias("least")), "equal")
    reps = sets.where("n > 0").join(equal.select("rep").where("rep IS NOT NULL").distinct(), F.col("doc_id") == F.col("rep"), "left_semi")
    again = twice.join(rows.select("doc_id", "doc").where("doc < 0"), F.col("_id") == F.col("doc_id")).select(F.col("doc").alias("_id")).distinct()
    again = stored(again, "again")
    # the join above has dealt rows by id already: rows that share a text's number are the same there
    reps, texts = stored(reps.drop("id", "th").dropDuplicates(["doc_id"]), "reps"), one_row_per(texts, ["doc_id"], again)
    group = Window.partitionBy("sig")
    sigs = reps.select(F.explode("sigs").alias("sig"), F.col("doc_id").alias("doc"), "n")
    first = stored(sigs.withColumns({"hub": F.min("doc").over(group), "m": F.count("*").over(group)}).where("m > 1"), "members")
    asked = stored(_possible(first.where("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct(), reps, percent), "asked")
    similar = lambda t: t.where((F.col("both") > 0) & (100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both")))).select("a", "b")
    pairs, links = asked, None
    for left in reversed(range(rounds)):
        # the first round's pairs grow with the input: one plan at every size
        seen = _compared(pairs, texts, width, percent, frequent, "merge" if pairs is asked else "auto")
        links = similar(seen) if links is None else links.unionByName(similar(seen))
        roots = stored(components(links), "components")
        members, direct = _still_open(seen, roots, percent)
        if pairs is asked:
            direct = direct.unionByName(_possible(_beside_hub(first, asked, roots, percent), reps, percent)).distinct()
        pairs = stored(_hub_pairs(members) if left else _all_pairs(members, percent), "pairs")
        direct = stored(direct if left else direct.unionByName(pairs).distinct(), "direct")
        if not direct.isEmpty():
            links = links.unionByName(similar(_compared(direct, texts, width, percent, frequent)))
        if pairs.isEmpty():
            break
    roots = stored(components(links), "components")
    frequent.unpersist()
    of_key = equal.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("key").alias("k"), F.coalesce("root", "rep").alias("root"), "least")
    of_key = stored(of_key, "sets-of-components")
    names = of_key.where("root IS NOT NULL").groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component"))
    named = of_key.join(names, F.col("root") == F.col("r"), "left").select("k", "root", "component")
    out = sets.select(F.col("id").alias("doc_id"), "th", "n", "key").join(named, F.col("key") == F.col("k"), "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("root")).alias("root"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def near_components(docs, width=4, percent=85, rounds=3):
    """doc_id, n_shingles and component_id (smallest id that links reach) of every row of ``docs`` (doc_id, text)."""
    return grouped(docs, width, percent, rounds).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs, width=5, percent=80):
    """``docs`` with one row of every component (that of the smallest id); rows without words or id stay, rows equal in id and text are one."""
    groups = stored(grouped(docs, width, percent), "groups").where("n_shingles > 0 AND doc_id IS NOT NULL AND root IS NOT NULL")
    name = F.struct("doc_id", "th")
    first = groups.groupBy(F.col("root").alias("r")).agg(F.min(name).alias("first"))
    others = groups.join(first, F.col("root") == F.col("r")).where(name != F.col("first")).select(F.col("doc_id").alias("_doc"), F.col("th").alias("_text")).distinct()
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), text_hash().alias("_text"))
    single = one_row_per(whole, ["_doc", "_text"], repeated_ids(whole, "_doc"))
    return without(single, ["_doc", "_text"], stored(others, "gone")).select("_row.*")
