"""Golden, shadow and document matching joins."""

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gavelwork.functions.text import digits, key_money, let
from gavelwork.session import checkpoint_dir


def golden_match(golden, predicted, key="expediente"):
    """Golden records with their prediction, and the predicted keys that no golden record has."""
    inner = golden.alias("g").join(predicted.alias("p"), key)
    return inner, predicted.join(golden, key, "left_anti")


def shadow_compare(left, right, keys=("document_id", "field")):
    """Parser against parser plus rules, per field, with the winner."""
    keys = list(keys)
    a = left.select(*keys, F.col("value").alias("pv"), F.col("confidence").alias("pc"))
    b = right.select(*keys, F.col("value").alias("kv"), F.col("confidence").alias("kc"))
    j = a.join(b, keys, "full")
    same = F.col("pv").eqNullSafe(F.col("kv"))
    winner = (F.when(same, "tie").when(F.col("pv").isNull(), "knowledge").when(F.col("kv").isNull(), "parser")
              .when(F.col("kc") > F.col("pc"), "knowledge").otherwise("parser"))
    return j.withColumns({"winner": winner, "difference": ~same})


def shadow_summary(df):
    from gavelwork.operators.boards import percent
    w = F.col("winner")
    return df.agg(F.count("*").alias("total_comparisons"), F.count_if(w == "parser").alias("parser_wins"), F.count_if(w == "knowledge").alias("knowledge_wins"),
                  F.count_if(w == "tie").alias("ties"), F.count_if("difference").alias("differences"),
                  percent(F.count_if(w == "knowledge"), F.count("*"), 2).alias("knowledge_improvement"))


def mode_differences(parser, knowledge, ai, keys=("document_id", "field")):
    """Fields whose (status, value) differs between the three runs."""
    keys = list(keys)
    sides = [d.select(*keys, F.struct("status", "value").alias(n)) for n, d in (("p", parser), ("k", knowledge), ("a", ai))]
    j = reduce(lambda x, y: x.join(y, keys, "full"), sides)
    return j.filter(~(F.col("p").eqNullSafe(F.col("k")) & F.col("k").eqNullSafe(F.col("a"))))


def best_pairing(left, right, fields):
    """Best right notice for each left notice of the same document.

    Score = (exact + half of the normalised agreements) / number of fields; the first right notice wins ties. Readings that agree
    on every field are settled by a hash join on the whole record; equal readings share one comparison, and only the distinct rest
    is compared inside the document.
    """
    def record(df):
        return F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields])), 256)

    a, b = left.withColumn("_h", record(left)), right.withColumn("_h", record(right))
    exact_first = b.groupBy("document_id", "_h").agg(F.min("id").alias("rid"))
    hit = a.join(exact_first, ["document_id", "_h"], "left")
    settled = hit.filter("rid IS NOT NULL").select("id", "document_id", "rid", F.lit(len(fields)).alias("exactos"), F.lit(0).alias("normalizados"))
    open_rows = hit.filter("rid IS NULL").drop("rid")
    owner = open_rows.groupBy("document_id", "_h").agg(F.min("id").alias("owner"))
    rest = open_rows.join(owner, ["document_id", "_h"]).filter("id = owner").drop("owner")
    reps = b.withColumn("_rep", F.col("id")).join(exact_first.withColumnRenamed("rid", "_rep"), ["document_id", "_h", "_rep"], "left_semi")
    def sides(df):
        plain = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
        return df.select("id", "document_id", F.array(*plain).alias("v"), F.array(*[key_money(c) for c in plain]).alias("n"))

    j = sides(rest).alias("l").join(sides(reps).alias("r"), "document_id")
    exact = sum((F.when(F.get("l.v", F.lit(i)) == F.get("r.v", F.lit(i)), 1).otherwise(0) for i in range(len(fields))), F.lit(0))
    norm = sum((F.when((F.get("l.v", F.lit(i)) != F.get("r.v", F.lit(i))) & (F.get("l.n", F.lit(i)) == F.get("r.n", F.lit(i))), 1).otherwise(0)
                for i in range(len(fields))), F.lit(0))
    scored = j.select(F.col("l.id").alias("id"), "document_id", F.col("r.id").alias("rid"), exact.alias("exactos"), norm.alias("normalizados"))
    best = scored.groupBy("id", "document_id").agg(F.max_by(
        F.struct("rid", "exactos", "normalizados"), F.struct(F.col("exactos") * 2 + F.col("normalizados"), -F.col("rid"))).alias("m"))
    found = best.select(F.col("id").alias("owner"), "m.rid", "m.exactos", "m.normalizados")
    shared = open_rows.join(owner, ["document_id", "_h"]).join(found, "owner").select("id", "document_id", "rid", "exactos", "normalizados")
    out = settled.unionByName(shared)
    return out.withColumn("score", F.round((F.col("exactos") + F.col("normalizados") * 0.5) / len(fields), 4))


WINDOW = 8
FILTER_BITS = 20
DOCKET_BITS = 26


def _cell(size, value, bits):
    """Word and bit of a bit table for a value of that size: each size has its own place in the table."""
    h = F.pmod(F.xxhash64(size, value), F.lit(1 << bits))
    return F.shiftright(h, 6), (h % 64).cast("int")


def _bit_table(rows, size, value, bits):
    """(w, bits): which pairs of size and value there may be; at most 2 ** (bits - 6) rows."""
    word, bit = _cell(size, value, bits)
    return rows.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))


def _let_through(rows, size, value, bits, table):
    """Rows whose size and value may be in a bit table, which is broadcast."""
    word, bit = _cell(size, value, bits)
    own = rows.columns
    return rows.withColumns({"w": word, "b": bit}).join(F.broadcast(table), "w").filter("shiftright(bits, b) & 1 = 1").select(own)


def docket_anchors(texts, dockets):
    """(expediente, document_id, at): first place of every docket in the digit stream of every text that contains it.

    A docket is looked up by one fingerprint, its last ``WINDOW`` digits (all, if it is shorter). A text gives its windows of these lengths
    position by position; a bit table of the fingerprints, of fixed size and broadcast, lets only those through that may be one, a larger one
    of whole dockets those of their digits, of each length that a docket has, that may be a docket. Only these are shuffled, the first place in
    a text of each. Digits are bytes: a part of bytes costs its own length, a part of a string that of the whole string.
    """
    t = digits(F.col("expediente")).cast("binary")
    d = dockets.withColumn("_t", t).filter("length(_t) > 0").withColumn("m", F.least(F.length("_t"), F.lit(WINDOW)))
    keys = d.select("_t", "m", F.substring(F.col("_t"), F.length("_t") - F.col("m") + 1, F.col("m")).alias("fp")).distinct()
    streams = texts.select("document_id", digits(F.col("text")).cast("binary").alias("_s"))
    known = keys.agg(F.struct(F.collect_set("m").alias("sizes"), F.collect_set(F.length("_t")).alias("lengths"))).scalar()  # a subquery of the same plan
    places = streams.withColumn("e", F.explode(F.when(F.length("_s") > 0, F.sequence(F.lit(1), F.length("_s")))))
    grams = places.withColumn("m", F.explode(known["sizes"])).filter("m <= e")
    grams = grams.withColumn("fp", F.substring(F.col("_s"), F.col("e") - F.col("m") + 1, F.col("m")))
    likely = _let_through(grams, "m", "fp", FILTER_BITS, _bit_table(keys, "m", "fp", FILTER_BITS))
    # a fingerprint may end many dockets: a place stands once for each length of a docket and meets whole dockets only
    likely = likely.select("document_id", "_s", "e", "m", F.explode(known["lengths"]).alias("n"))
    likely = likely.filter(F.col("n") <= F.col("e")).filter(F.least(F.col("n"), F.lit(WINDOW)) == F.col("m"))
    likely = likely.select("document_id", "n", F.substring(F.col("_s"), F.col("e") - F.col("n") + 1, F.col("n")).alias("_t"), (F.col("e") - F.col("n") + 1).alias("at"))
    likely = _let_through(likely, "n", "_t", DOCKET_BITS, _bit_table(keys.withColumn("n", F.length("_t")), "n", "_t", DOCKET_BITS))
    found = likely.groupBy("document_id", "_t").agg(F.min("at").alias("at")).join(keys.select("_t"), "_t")
    return d.join(found, "_t").drop("_t", "m")


BIN = 4096


def range_lookup(points, ranges, keys, point="pos", start="start", end="end", width=BIN):
    """Ranges that hold each point (start <= point < end), by equality on the keys and on bins of ``width`` positions.

    A long range stands in every bin that it touches, so a document with many points and ranges is split by position.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    last = F.floor((F.col(end) - 1) / width)
    binned = ranges.filter(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), last)))
    hit = points.withColumn("_bin", F.floor(F.col(point) / width)).join(binned, [*keys, "_bin"])
    return hit.filter((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end))).drop("_bin")


BLOCK_START = r"(?m)^\s*(?:EJ|DIV)\s*\."
PIECE = 512


STEP = 256


def _sums(counts):
    """What stands before each element of an array of counts, and all of it at the end; taken by stretches of ``STEP``, as an array grows by copies."""
    def fold(values, start):
        return F.aggregate(values, F.array(start), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def stretches(c):
        cut = F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1)), F.lit(STEP)), lambda i: F.slice(c, i, F.lit(STEP)))).otherwise(F.array().cast("array<array<int>>"))
        return let(cut, lambda parts: let(fold(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda x, n: x + n)), F.lit(0)), lambda heads: F.concat(
            F.flatten(F.zip_with(parts, F.slice(heads, F.lit(1), F.size(parts)), lambda p, h: F.slice(fold(p, h), F.lit(1), F.size(p)))), F.slice(heads, F.lit(-1), F.lit(1)))))

    return let(counts, stretches)


def _placed(texts, anchors):
    """document_id, text, _as, _at: texts with their anchors (expediente, pos, hasta), sorted by pos, and these pos.

    pos is the 0-based character of the docket's first digit, hasta the one after its last. A text is cut into pieces of ``PIECE`` characters, and
    a digit is looked for in its own piece.
    """
    span = F.struct("at", (F.col("at") + F.length(digits(F.col("expediente"))) - 1).alias("last"), "expediente")
    own = anchors.groupBy("document_id").agg(F.array_sort(F.collect_list(span)).alias("_as"))
    d = texts.select("document_id", "text").join(own, "document_id").withColumn("_ps", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    d = d.withColumn("_ds", _sums(F.transform("_ps", lambda p: F.length(digits(p)))))

    def place(nth):
        def inside(k):
            rest = F.element_at(F.split(F.get("_ps", k), "[0-9]", nth - F.get("_ds", k) + 1), -1)
            return k * PIECE + F.length(F.get("_ps", k)) - F.length(rest) - 1

        return let(_rank(F.col("_ds"), nth - 1) - 1, inside)

    d = d.withColumn("_as", F.transform("_as", lambda a: F.struct(a["expediente"].alias("expediente"), place(a["at"]).alias("pos"), (place(a["last"]) + 1).alias("hasta"))))
    return d.select("document_id", "text", "_as", F.transform("_as", lambda a: a["pos"]).alias("_at"))


def anchored_regions(texts, dockets):
    """expediente, document_id, pagina, inicio, fin, texto: the notice block of a page that holds a docket, or the line where no block does.

    Documents are cut at their page marks, a docket belongs to the page on which its first occurrence in the document begins, and there to the
    block that its first occurrence on the page falls into. ``inicio`` and ``fin`` are places in the page's text.

    The first occurrence in the document is the first one on its page too if it ends there; if it does not, a later one cannot end there either,
    so the page has none. Texts are read once for the anchors and once, with the anchors of each, for all the rest.
    """
    from gavelwork.operators.splitting import split_pages

    d = _placed(texts, docket_anchors(texts.select("document_id", "text"), dockets))
    pages = split_pages(d, ["document_id", "_as", "_at"])
    first = _rank(F.col("_at"), F.col("inicio") - 1)
    pages = pages.withColumns({"_first": first, "_n": _rank(F.col("_at"), F.col("fin") - 1) - first})
    read = F.when(F.col("_n") > 0, F.col("texto"))
    pages = pages.withColumns({"_parts": F.split(read, BLOCK_START), "_marks": F.regexp_extract_all(read, F.lit(f"({BLOCK_START})"), 1)})
    ends = _sums(F.transform("_parts", lambda p, i: F.length(p) + F.coalesce(F.length(F.get("_marks", i)), F.lit(0))))
    starts = F.zip_with("_marks", F.slice(ends, F.lit(2), F.size("_marks")), lambda m, e: e - F.length(m))
    pages = pages.withColumn("_starts", F.concat(starts, F.array(F.length("texto"))))
    # outer, for else a filter on the size is inferred that makes the array a second time
    out = pages.select("document_id", "pagina", "texto", "inicio", "fin", "_starts", F.explode_outer(F.slice("_as", F.col("_first") + 1, F.col("_n"))).alias("a")).filter("a.hasta <= fin")
    out = out.select("document_id", "pagina", "texto", "_starts", "a.expediente", (F.col("a.pos") - F.col("inicio")).alias("pos"), (F.col("a.hasta") - F.col("inicio")).alias("hasta"))
    out = out.withColumn("k", _rank(F.col("_starts"), F.col("pos")))
    head, tail = F.substring(F.col("texto"), F.lit(1), F.col("pos")), F.substring(F.col("texto"), F.col("hasta") + 1, F.length("texto"))
    held = F.col("k") > 0
    out = out.withColumns({"inicio": F.when(held, F.get("_starts", F.col("k") - 1)).otherwise(F.col("pos") - F.length(F.substring_index(head, "\n", -1))),
                           "fin": F.when(held, F.get("_starts", F.col("k"))).otherwise(F.col("hasta") + F.length(F.substring_index(tail, "\n", 1)))})
    return out.select("expediente", "document_id", "pagina", "inicio", "fin", F.substring(F.col("texto"), F.col("inicio") + 1, F.col("fin") - F.col("inicio")).alias("texto"))


def first_document(anchors, golden, documents):
    """First document, in list order, that contains the docket; the first of all when none does."""
    best = anchors.join(documents, "document_id").groupBy("expediente").agg(F.min_by("document_id", "orden").alias("document_id"))
    fallback = documents.agg(F.min_by("document_id", "orden").alias("fallback")).scalar()
    return golden.select("expediente").join(best, "expediente", "left").select("expediente", F.coalesce("document_id", fallback).alias("document_id"))


def _rank(values, x):
    """How many values of a sorted array are x at most, found by halves."""
    size = F.size(values)
    steps = F.transform(F.sequence(F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= size) & (F.get(values, p + s - 1) <= x), p + s).otherwise(p))


def _holds(whole, part):
    """All values of an array stand in another, sorted one: each is looked up by halves, so a pair costs what the smaller one holds."""
    return F.forall(part, lambda x: F.coalesce(F.get(whole, _rank(whole, x) - 1) == x, F.lit(False)))


CELLS = 20
KEYS = 25
FINGERPRINT = 31
SIGN = 4


def contained_documents(df):
    """Word sets of one page that lie inside another: (a, b, words of a, copies of a, copies of b), by representative document.

    Documents with the same words are one set, so a pile of copies costs one row; a set with copies is listed with itself. b must hold one
    word of a, so only those sets are compared: the word that is rarest by the numbers of 2 ** CELLS cells. Words are 64-bit hashes with their page,
    kept once for each set; a bit table of 2 ** KEYS bits, broadcast, lets only those words through that may be the one of some set, and only these
    are shuffled. Sets meet by a fingerprint of the word, signatures of 64 * SIGN bits sort out most, and every pair left is verified whole.
    """
    checkpoint_dir(df.sparkSession)
    d = df.select("page", "doc_id", F.sort_array(F.array_distinct("words")).alias("ws")).filter(F.size("ws") > 0)
    d = d.select("page", "doc_id", F.unhex(F.sha2(F.array_join("ws", " "), 256)).alias("h"), F.sort_array(F.transform("ws", lambda w: F.xxhash64("page", w))).alias("ks")).checkpoint()
    groups = d.groupBy("page", "h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copias"), F.max(F.size("ks").cast("bigint")).alias("n"))
    sets = d.join(groups, ["page", "h", "doc_id"]).dropDuplicates(["page", "h", "doc_id"]).select("page", "doc_id", "copias", "n", "ks").checkpoint()
    words = sets.select("page", "doc_id", "copias", "n", F.explode("ks").alias("k"))
    words = words.withColumns({"cell": F.pmod("k", F.lit(1 << CELLS)), "fp": F.pmod("k", F.lit(1 << FINGERPRINT)), "bit": F.shiftrightunsigned("k", 48)})
    cells = words.groupBy("cell").agg(F.least(F.count("*"), F.lit((1 << 31) - 1)).alias("c"))
    rarest = F.min(F.col("c") * (1 << FINGERPRINT) + F.col("fp"))  # number first, fingerprint behind it
    signs = [F.bit_or(F.when(F.pmod("bit", F.lit(64 * SIGN)).between(64 * i, 64 * i + 63), F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).otherwise(0)).alias(f"s{i}") for i in range(SIGN)]
    info = words.join(F.broadcast(cells), "cell").groupBy("page", "doc_id").agg(F.max("copias").alias("copias"), F.max("n").alias("n"), rarest.alias("fp"), *signs)
    info = info.withColumn("fp", F.pmod("fp", F.lit(1 << FINGERPRINT))).checkpoint()
    at = F.pmod("fp", F.lit(1 << KEYS))
    table = info.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(fp & 63 AS INT))")).alias("bits"))
    likely = words.withColumn("w", F.shiftright(at, 6)).join(F.broadcast(table), "w").filter("shiftright(bits, CAST(fp & 63 AS INT)) & 1 = 1").select("page", "doc_id", "fp")
    large = likely.join(info.drop("fp"), ["page", "doc_id"]).select("page", "fp", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("copias").alias("copias_b"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(SIGN)])
    met = info.withColumnsRenamed({"doc_id": "a", "copias": "copias_a"}).join(large, ["page", "fp"]).filter("n < nb")
    met = met.filter(" AND ".join(f"s{i} & ~t{i} = 0" for i in range(SIGN))).select("page", "a", "b", "n", "copias_a", "copias_b")
    part, whole = [sets.select("page", F.col("doc_id").alias(x), F.col("ks").alias(f"k{x}")) for x in "ab"]
    inside = met.join(part, ["page", "a"]).join(whole, ["page", "b"]).filter(_holds("kb", "ka")).select("page", "a", "b", "n", "copias_a", "copias_b")
    same = groups.filter("copias > 1").select("page", F.col("doc_id").alias("a"), F.col("doc_id").alias("b"), "n", F.col("copias").alias("copias_a"), F.col("copias").alias("copias_b"))
    return inside.unionByName(same)


def latest_per_key(df, keys, order):
    """Latest row per key by max_by over a struct; nothing is sorted."""
    others = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])
