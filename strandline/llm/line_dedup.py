"""Line dedup: of lines that are equal or nearly so, the first one stays.

Method: a segment-partition edit join. A line of n characters is split into ``most`` + 1 segments; of two
lines within ``most`` edits, the longer one holds a segment of the shorter one unchanged, close to its place.
Segments of each line are an index by (segment number, length, text); each line probes it with those of
its substrings that can be aligned with a segment of a line of its length or up to ``most`` less. Pairs that meet
are verified by banded bit-parallel edit distance. Links are transitive.

A bucket of the index with at most ``COLD`` lines gives pairs, so their number is bounded by that of the probes. The
lines of a larger one are dealt into blocks of bounded size. A block is one row, in which lines are compared until they
are connected, and which gives a forest of its links. Some lines of the bucket are in all its blocks. Blocks then
meet in pairs, except those whose lines are connected by now. Rows thus follow the input, but lines of a large bucket
that are no near repeats of one another are still compared two by two within these rows.

The first line of a class is that of the smallest (id, hash of text, line number). Lines of under ``shortest``
characters are repeats only of lines that are equal; empty lines always stay. DataFrame functions only.

A null text has no lines and stays null; an empty one has one empty line. Long texts and lines are worked on
whole. Rows that share an id alone are documents of their own; of rows that repeat an id and its text any one
has the lines that stay, the others only empty lines. An empty table gives an empty one. Further columns
are kept, whatever their names; n_lines and n_kept are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import dropped, stored

MOST, SHORTEST = 2, 16
#: Letters whose numbers in two lines of a tile are compared before their edit distance. Any letters do: an edit
#: changes two of the numbers by one at most.
LETTERS = "etaoin"
#: A bucket with more index lines than ``COLD`` is hot: it gives no pairs, its lines are compared in tiles.
COLD = 16
#: Lines of a block of a hot bucket, and their characters; a tile is two blocks at most, and the pivots.
BLOCK, BLOCK_CHARS, PIVOTS = 128, 1 << 22, 8
#: Verification fetches the lines of candidate pairs by a broadcast of their hashes up to so many of them
#: (8 bytes each), by a shuffled join beyond that.
BROADCAST = 400_000


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def edit_distance(a: Column, b: Column, most: int = MOST) -> Column:
    """The edit distance of two strings up to ``most``, and some larger number beyond.

    What both begin or end with alike costs no edits, so most of it goes first. Both need more than 2 most characters.
    """
    least = 2 * most + 1

    def two(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    def rest(s: Column) -> Column:
        """Both without most of what they begin with alike, and from right to left."""
        return _let(_alike(s["x"], s["y"], least), lambda k: two(*(F.reverse(F.substring(s[c], k + 1, F.char_length(s[c]))) for c in "xy")))

    def letters(s: Column) -> Column:
        return two(F.split(s["x"], ""), F.split(s["y"], ""))

    def banded(s: Column) -> Column:
        return F.when(F.size(s["x"]) - F.size(s["y"]) > most, F.lit(most + 1)).otherwise(_banded(s["x"], s["y"], most))

    ordered = F.when(F.char_length(a) >= F.char_length(b), two(a, b)).otherwise(two(b, a))
    return _let(ordered, lambda s: _let(rest(s), lambda r: _let(rest(r), lambda q: _let(letters(q), banded))))


def _alike(x: Column, y: Column, least: int) -> Column:
    """A number of characters that both begin with; ``least`` of y's stay. Each step tries half as many as the one before."""
    room = F.greatest(F.char_length(y) - least, F.lit(0))
    sizes = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.floor(room / F.pow(F.lit(2.0), k)).cast("int"))
    return F.aggregate(sizes, F.lit(0), lambda at, size: F.when(F.substring(x, at + 1, size) == F.substring(y, at + 1, size), at + size).otherwise(at))


def _banded(x: Column, y: Column, most: int) -> Column:
    """Banded bit-parallel edit distance of arrays of characters, x the longer one.

    Bit k of a column's state is the cell k - most off the diagonal; the columns follow the shorter
    string, whose character is compared with the 2 most + 1 characters of the longer one in the band.
    """
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << (width - 1)

    n, m = F.size(x), F.size(y)
    limit = m - n + 2 * most

    def inverse(v: Column) -> Column:
        return F.lit(full).cast("bigint") - v.bitwiseAND(full)

    def step(state: Column, i: Column) -> Column:
        char = F.get(y, i)
        equal = sum((F.when(F.get(x, i + (k - most)) == char, F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") if k >= most else F.when((i >= most - k) & (F.get(x, F.greatest(i + (k - most), F.lit(0))) == char), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint")) for k in range(width))
        vp, vn, d = state["vp"], state["vn"], state["d"]

        def cells(e: Column) -> Column:
            return ((e.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(e).bitwiseOR(vn).bitwiseAND(full)

        def moved(d0: Column) -> Column:
            hp = vn.bitwiseOR(inverse(d0.bitwiseOR(vp)))
            hn = d0.bitwiseAND(vp)
            return _let(F.struct(hp.alias("hp"), hn.alias("hn")), lambda h: after(d0, h["hp"], h["hn"]))

        def after(d0: Column, hp: Column, hn: Column) -> Column:
            half = F.shiftright(d0, 1)
            along = F.when(d0.bitwiseAND(top) == 0, F.lit(1)).otherwise(F.lit(0))
            # past the end of x the last row is one bit lower for each column
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.lit(width - 2) - (i - (n - most)), F.lit(0)))
            level = F.when(hp.bitwiseAND(bit) != 0, F.lit(1)).when(hn.bitwiseAND(bit) != 0, F.lit(-1)).otherwise(F.lit(0))
            score = d + F.when(i < n - most, along).otherwise(level)
            return F.struct(hn.bitwiseOR(inverse(half.bitwiseOR(hp))).alias("vp"), half.bitwiseAND(hp).alias("vn"), score.cast("int").alias("d"))

        return F.when(d > limit, state).otherwise(_let(equal, lambda e: _let(cells(e), moved)))

    begin = F.struct(F.lit(full & ~((1 << most) - 1)).cast("bigint").alias("vp"), F.lit(0).cast("bigint").alias("vn"), F.lit(most).cast("int").alias("d"))
    return F.aggregate(F.sequence(F.lit(0), m - 1), begin, step)["d"]


def _cut(n: Column, k: int, parts: int) -> Column:
    """Where segment k of n characters begins."""
    return F.floor(n * k / parts).cast("int")


def index_keys(line: Column, n: Column, most: int) -> Column:
    parts = most + 1
    return F.array(*(F.xxhash64(F.lit(k), n, F.substring(line, _cut(n, k, parts) + 1, _cut(n, k + 1, parts) - _cut(n, k, parts))) for k in range(parts)))


def probe_keys(line: Column, n: Column, most: int, shortest: int) -> Column:
    """Keys of the substrings that may equal segment k of a line ``less`` characters shorter.

    The segment's shift is at most k by the edits before it and within most - k of ``less`` by those after it, or
    one more edit would have left another segment unchanged. For lines of equal length a shift to the left in one
    is one to the right in the other, which probes too; without a shift their index keys are equal.
    """
    parts, keys = most + 1, []
    for less in range(most + 1):
        m = n - less
        for k in range(parts):
            begin, size = _cut(m, k, parts), _cut(m, k + 1, parts) - _cut(m, k, parts)
            for shift in range(max(-k, less - (most - k), 1 if less == 0 else -k), min(k, less + (most - k)) + 1):
                inside = (begin + shift >= 0) & (begin + shift + size <= n) & (m >= shortest)
                keys.append(F.when(inside, F.xxhash64(F.lit(k), m, F.substring(line, begin + shift + 1, size))))
    return F.array(*keys)


def sketch(line: Column) -> Column:
    """The numbers of ``LETTERS`` in a line, modulo 32, in five bits each."""
    out = F.lit(0).cast("bigint")
    for k, letter in enumerate(LETTERS):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))  # bytes are told faster, and a letter is one
        out = out + (count % 32).cast("bigint") * (1 << 5 * k)
    return out


def _may_be_near(a: Column, b: Column, most: int) -> Column:
    """Whether sketches allow ``most`` edits: each changes the numbers by two in sum."""
    total = F.lit(0)
    for k in range(len(LETTERS)):
        apart = F.abs(F.shiftright(a, 5 * k).bitwiseAND(31) - F.shiftright(b, 5 * k).bitwiseAND(31))
        total = total + F.least(apart, 32 - apart)
    return total <= 2 * most


def forest(members: Column, most: int) -> Column:
    """Links (a, b) that connect what is near among ``members`` (node, side, sketch, line, comp), in one row.

    Members with the same ``comp`` are connected already, two without ``side`` are not compared. Whatever has become
    connected meanwhile is not compared either, so there are fewer links than members.
    """
    link = "array<struct<a:bigint,b:bigint>>"
    start = F.struct(F.transform(members, lambda m: m["comp"]).alias("label"), F.array().cast(link).alias("links"))

    def at(state: Column, i: Column, j: Column) -> Column:
        x, y, old, new = F.get(members, i), F.get(members, j), F.get(state["label"], i), F.get(state["label"], j)
        meet = (old != new) & (x["side"] | y["side"]) & _may_be_near(x["sketch"], y["sketch"], most) & (edit_distance(x["line"], y["line"], most) <= most)
        joined = F.transform(state["label"], lambda c: F.when(c == old, new).otherwise(c))
        one = F.array(F.struct(x["node"].alias("a"), y["node"].alias("b"))).cast(link)
        return F.when(meet, F.struct(joined.alias("label"), F.concat(state["links"], one).alias("links"))).otherwise(state)

    def all_before(state: Column, i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), i - 1), state, lambda s, j: at(s, i, j))

    links = F.aggregate(F.sequence(F.lit(1), F.size(members) - 1), start, all_before, lambda s: s["links"])
    return F.when(F.size(members) > 1, links)


def _linked(rows: DataFrame, texts: DataFrame, tile: list[str], most: int) -> DataFrame:
    """Links (a, b) within the tiles of ``rows`` (tile columns, h, side, comp or none)."""
    comp = F.col("comp") if "comp" in rows.columns else F.col("node").alias("comp")
    member = F.struct("node", "side", sketch(F.col("line")).alias("sketch"), "line", comp)
    held = rows.join(texts, "h").groupBy(*tile).agg(F.collect_set(member).alias("members"))  # tiles have a bounded size
    return held.select(F.explode(forest(F.col("members"), most)).alias("link")).select("link.*")


def _blocks(n: Column, size: Column) -> Column:
    return F.ceil(F.greatest(n / BLOCK, size / BLOCK_CHARS)).cast("int")


def _hot_first(members: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """Links within blocks of each hot bucket. ``PIVOTS`` of a bucket's lines are in all its blocks, so what is near to them
    becomes connected across blocks."""
    dealt = members.where("blocks = 1").select("key", F.lit(0).alias("block"), "h", "side")
    several = members.where("blocks > 1")
    dealt = dealt.unionByName(several.select("key", F.pmod(F.xxhash64("h"), "blocks").cast("int").alias("block"), "h", "side"))
    smallest = [F.min(F.struct(F.xxhash64("h", F.lit(k)), "h", "side")).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = several.groupBy("key", "blocks").agg(*smallest).select("key", "blocks", F.explode(F.array(*(F.struct(f"p{k}.h", f"p{k}.side") for k in range(PIVOTS)))).alias("p"))
    pivots = pivots.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "p.h", "p.side")
    return _linked(dealt.unionByName(pivots), texts, ["key", "block"], most)


def _hot_rest(members: DataFrame, texts: DataFrame, found: DataFrame, most: int) -> DataFrame | None:
    """Links between lines of hot buckets that have not met: blocks of one component each, and blocks of lines from small
    components, are paired, but no component with itself."""
    known = found.select(F.col("id").alias("node"), "component")
    named = members.where("blocks > 1").join(texts.select("h", "node", F.char_length("line").alias("n")), "h").join(known, "node", "left")
    named = stored(named.select("key", "h", "side", F.coalesce("component", "node").alias("comp"), "n"), "line-hot-named")
    sizes = named.groupBy("key", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    large = sizes.select("key", "comp", (_blocks(F.col("k"), F.col("n")) > 1).alias("large"), "k", "n")
    grouped = large.groupBy("key", F.when(F.col("large"), F.col("comp")).alias("own")).agg(_blocks(F.sum("k"), F.sum("n")).alias("blocks"))
    blocks = grouped.select("key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).select("key", "own", F.xxhash64("key", "own", "k").alias("block"))
    one, other = (blocks.select("key", F.col("own").alias(f"own_{c}"), F.col("block").alias(c)) for c in ("i", "j"))
    meet = (F.col("i") <= F.col("j")) & (F.col("own_i").isNull() | F.col("own_j").isNull() | (F.col("own_i") != F.col("own_j")))
    pairs = stored(one.join(other, "key").where(meet).select("key", "i", "j"), "line-tiles")
    if pairs.isEmpty():
        return None
    own = F.when(F.col("large"), F.col("comp"))
    placed = named.join(large.select("key", "comp", "large"), ["key", "comp"]).withColumn("own", own)
    placed = placed.join(grouped.select(F.col("key").alias("g"), F.col("own").alias("g_own"), "blocks"), (F.col("key") == F.col("g")) & F.col("own").eqNullSafe(F.col("g_own")))
    placed = placed.select(F.xxhash64("key", "own", F.pmod(F.xxhash64("h"), "blocks").cast("int")).alias("block"), "h", "side", "comp")
    tiles = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return _linked(placed.join(tiles, "block"), texts, ["i", "j"], most)


def kept_lines(docs: DataFrame, most: int = MOST, shortest: int = SHORTEST, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, th, pos) of the lines with characters that stay; th is the text's hash."""
    shortest = max(shortest, 2 * most + 2)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where(F.col("text").isNotNull()).withColumn("th", F.xxhash64("text"))
    lines = rows.select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("n", F.char_length("line")).where("n > 0")
    hashed = lines.withColumn("h", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("second"), F.col("line")))
    first = F.min(F.struct("id", "th", "pos")).alias("first")
    if most == 0:
        return hashed.groupBy("h", "h2").agg(first).select("first.*")
    long = F.col("n") >= shortest
    keyed = hashed.select("id", "th", "pos", "h", "h2", F.when(long, index_keys(F.col("line"), F.col("n"), most)).alias("own"), probe_keys(F.col("line"), F.col("n"), most, shortest).alias("probes"))
    keyed = keyed.groupBy("h", "h2").agg(first, *(F.first(c).alias(c) for c in ("own", "probes")))
    keyed = stored(keyed, "line-classes")
    classes = keyed.select("h", "h2", "first.*")
    index = keyed.select(F.explode("own").alias("key"), "h")
    probes = keyed.select(F.explode("probes").alias("key"), "h").where(F.col("key").isNotNull())
    hot = stored(index.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > COLD).select("key"), "line-hot-keys")

    # a bucket of few index lines gives each line that meets them as few pairs
    cold, asking = index.join(hot, "key", "left_anti"), probes.join(hot, "key", "left_anti")
    one = cold.select("key", F.col("h").alias("a"))
    pairs = one.join(cold.select("key", F.col("h").alias("b")), "key").where("a < b").select("a", "b")
    pairs = pairs.unionByName(one.join(asking.select("key", F.col("h").alias("b")), "key").where("a <> b").select("a", "b"))
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h"))
    some_hot = not hot.isEmpty()
    if some_hot:
        members = index.select("key", "h", F.lit(True).alias("side")).unionByName(probes.select("key", "h", F.lit(False).alias("side")))
        members = stored(members.join(hot, "key").groupBy("key", "h").agg(F.max("side").alias("side")), "line-hot-members")
        wanted = wanted.unionByName(members.select("h"))
    wanted = stored(wanted.distinct(), "line-candidates")
    small = wanted.count() <= BROADCAST
    texts = hashed.select("h", "h2", "line").join(F.broadcast(wanted) if small else wanted, "h", "left_semi").groupBy("h", "h2").agg(F.first("line").alias("line"))
    # lines that share h but not h2 get nodes of their own
    turn = F.row_number().over(Window.partitionBy("h").orderBy("h2"))
    texts = stored(texts.withColumn("node", F.when(turn == 1, F.col("h")).otherwise(F.xxhash64("h", "h2"))), "line-texts")
    lined = texts.select("h", "node", "line")
    left, right = (lined.select(F.col("h").alias(c), F.col("node").alias(f"{c}_node"), F.col("line").alias(f"{c}_line")) for c in ("a", "b"))
    # a table, since a filter would be pushed through the projections and multiply their expressions
    near = stored(pairs.join(left, "a").join(right, "b").select("a_node", "b_node", edit_distance(F.col("a_line"), F.col("b_line"), most).alias("distance")), "line-distances")
    links = near.where(F.col("distance") <= most).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    if some_hot:
        sizes = members.join(lined.select("h", F.char_length("line").alias("n")), "h").groupBy("key").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"))
        members = stored(members.join(sizes, "key"), "line-hot-dealt")
        links = links.unionByName(stored(_hot_first(members, lined, most), "line-hot-links"))
    found = components(links, "lines")
    if some_hot and (rest := _hot_rest(members, lined, found, most)) is not None:
        links = found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(stored(rest, "line-hot-rest"))
        found = components(links, "lines")
    grouped = classes.join(texts.select("h", "h2", "node"), ["h", "h2"]).join(found, F.col("node") == found["id"])
    grouped = stored(grouped.select("component", "h", "h2", classes["id"], "th", "pos"), "line-groups")
    dropped(hot, pairs, wanted, texts, near, *([members] if some_hot else []))
    ahead = grouped.groupBy("component").agg(first).select("first.*")
    alone = classes.join(grouped.select("h", "h2"), ["h", "h2"], "left_anti").select("id", "th", "pos")
    return alone.unionByName(ahead)


def dedup(docs: DataFrame, most: int = MOST, shortest: int = SHORTEST, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the text of the lines that stay, n_lines and n_kept."""
    kept = kept_lines(docs, most, shortest, text, id_col).groupBy("id", "th").agg(F.collect_list("pos").alias("kept"))  # at most a document's lines
    others = [c for c in docs.columns if c not in (text, "n_lines", "n_kept")]
    held = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("string")
    rows = docs.select(held.alias("rest"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    twin = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th"))
    kept = kept.select(F.col("id").alias("k_id"), F.col("th").alias("k_th"), "kept")
    repeated = stored(rows.groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("k_id"), F.col("th").alias("k_th")), "repeated-rows")
    if repeated.isEmpty():
        joined = rows.join(kept, twin, "left")
    else:  # of rows that repeat an id and its text the first alone has the lines that stay
        again = stored(rows.join(repeated, twin, "left_semi").withColumn("turn", F.monotonically_increasing_id()), "rows-again")
        first = again.groupBy(F.col("id").alias("k_id"), F.col("th").alias("k_th")).agg(F.min("turn").alias("first")).join(kept, ["k_id", "k_th"], "left")
        again = again.join(first, twin).select("rest", "id", "text", "th", F.when(F.col("turn") == F.col("first"), F.col("kept")).alias("kept"))
        joined = rows.join(repeated, twin, "left_anti").join(kept, twin, "left").select("rest", "id", "text", "th", "kept").unionByName(again)

    def stay(parts: Column) -> Column:
        blank = F.filter(F.transform(parts, lambda x, i: F.when(F.char_length(x) == 0, i)), lambda i: i.isNotNull())
        places = F.array_sort(F.concat(F.coalesce("kept", F.array().cast("array<int>")), blank))
        return F.struct(F.size(parts).alias("lines"), F.transform(places, lambda i: F.get(parts, i)).alias("kept"))

    # a generated column is computed once, whatever filters and projections follow
    made = F.when(F.col("text").isNotNull(), _let(F.split("text", "\n", -1), stay))
    out = joined.select("rest", F.explode(F.array(made)).alias("stay"))
    new = F.array_join("stay.kept", "\n")
    n_lines, n_kept = F.coalesce("stay.lines", F.lit(0)), F.when(F.col("stay").isNull(), 0).otherwise(F.size("stay.kept"))
    kinds = {f.name for f in docs.schema} - {"n_lines", "n_kept"}
    columns = [new.alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns if c in kinds]
    return out.select(*columns, n_lines.cast("long").alias("n_lines"), n_kept.cast("long").alias("n_kept"))
