"""Conversation prefix trie (operator 13), built as a burst trie over shards.

A turn's id is the 128-bit digest of role and text, a conversation the string of its turns' ids. Equal conversations
become one sequence with its members' count. The trie's top is made of heads: a head holds a container of the
sequences that begin with it. As long as a container holds more than LIMIT sequences it bursts: its head becomes an inner
node and its sequences move to containers by their next turn id; where all of them share more turns, the burst skips
those at once. The containers that remain are small. They are dealt to tasks by a hash of their head, sorted there,
and swept: neighbours in the order share a prefix, the turns after it open nodes, and a node that no later sequence
shares is closed, with its sums complete, into its parent's. Inner nodes above the containers add up what these give.

Hot turns and hot copies: copies meet before any shuffle by sequence, containers of a common first turn burst, and a
head with more than one in a thousand of all sequences meets them by broadcast (see `join_hot`). Only a node's member
ids are hashed in one task, as they stream by in order, since SHA-256 cannot be split.

Defined results: null roles and texts are empty; turns of equal number are taken by role, then text; a null turn comes
first. Rows without conv_id belong to no conversation and are left out. c%20 takes the sign of c. Repeated rows are
turns of their own. An empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, hot_keys, join_hot, stored

#: Sequences that a container may hold.
LIMIT = 256
#: Characters of a turn id in a path.
ID = 32
_WORD = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, path (the turns' ids in order), words (of each turn)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    name = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    named = rows.where("conv_id is not null").select("conv_id", place.alias("place"), name.alias("id"), F.regexp_count("text", F.lit(_WORD)).alias("n"))
    every = F.array_sort(F.collect_list(F.struct("place", "id", "n")))
    return named.groupBy("conv_id").agg(every.alias("t")).select("conv_id", F.array_join("t.id", "").alias("path"), F.col("t.n").alias("words"))


def rebuilt(sequences: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation with the first h turns of the one it is based on in place of its own, h by crc32 of its id."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % every
    own = sequences.withColumns({"h": h, "base": base})
    heads = sequences.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.substring("path", 1, ID * (most - 1)).alias("first"), F.slice("words", 1, most - 1).alias("first_words"))
    both = own.join(heads, "base", "left")
    path = F.concat(F.coalesce(F.substring("first", F.lit(1), F.col("h") * ID), F.lit("")), F.substring("path", F.col("h") * ID + 1, F.length("path")))
    rest = F.slice("words", F.col("h") + 1, F.greatest(F.size("words") - F.col("h"), F.lit(0)))
    words = F.concat(F.when(F.col("first_words").isNull(), F.array().cast("array<int>")).otherwise(F.slice("first_words", F.lit(1), F.col("h"))), rest)
    return both.select("conv_id", path.alias("path"), words.alias("words"))


def _members(conversations: DataFrame) -> DataFrame:
    """sequence, n, least, ends: each distinct sequence's members, hashed as they stream by in order."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("sequence", pa.string()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])
        now = digest = least = None
        n = 0
        for batch in batches:
            out = []
            for sequence, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sequence != now:
                    if now is not None:
                        out.append((now, n, least, digest.hexdigest()))
                    now, n, least, digest = sequence, 0, conv_id, hashlib.sha256()
                digest.update(f"{',' if n else ''}{conv_id}".encode())
                n += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((now, n, least, digest.hexdigest()), schema, strict=True)], schema=schema)

    ids = conversations.select("sequence", "conv_id").repartition("sequence").sortWithinPartitions("sequence", "conv_id")
    return ids.mapInArrow(run, "sequence string, n long, least long, ends string")


def sequences(conversations: DataFrame) -> DataFrame:
    """sequence (digest), path, words, n, least, ends of the distinct sequences of (conv_id, path, words)."""
    named = stored(conversations.withColumn("sequence", F.md5("path")))
    one = named.groupBy("sequence").agg(F.first("path").alias("path"), F.first("words").alias("words"))
    return one.join(_members(named), "sequence")


def _head(depth="depth"):
    return F.substring("path", F.lit(1), F.col(depth) * ID)


def burst(every: DataFrame, limit: int) -> DataFrame:
    """The sequences with the depth of their container's head; `inner` marks those that end at a head that has burst."""
    open_ = every.withColumn("depth", F.lit(0))
    done = []
    while True:
        open_ = stored(open_.withColumn("head", F.md5(_head())))
        size = open_.groupBy("head").agg(F.count("*").alias("n_here"), F.min("path").alias("low"), F.max("path").alias("high"), F.first("depth").alias("d"))
        size = stored(size)
        # the turns that least and greatest path share are shared by all
        same = F.expr(f"aggregate(sequence(1, cast(least(length(low), length(high)) div {ID} as int)), 0, (k, i) -> if(k = i - 1 and substring(low, {ID} * (i - 1) + 1, {ID}) = substring(high, {ID} * (i - 1) + 1, {ID}), i, k))")
        full = size.where(F.col("n_here") > limit).select("head", F.greatest(F.when(F.length("low") >= ID, same).otherwise(0), F.col("d")).alias("down"))
        if full.isEmpty():
            done.append(open_.select("*", F.lit(False).alias("inner")))
            break
        found = stored(join_hot(open_, full, ["head"], hot_keys(size, ["head"], "n_here"), "left"))
        ended = (F.col("down") * ID) == F.length("path")
        done.append(found.where("down is null").drop("down").withColumn("inner", F.lit(False)))
        done.append(found.where(F.col("down").isNotNull() & ended).withColumn("depth", F.col("down")).drop("down").withColumn("inner", F.lit(True)))
        open_ = found.where(F.col("down").isNotNull() & ~ended).withColumn("depth", F.col("down") + 1).drop("down", "head")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_EMPTY = hashlib.sha256(b"").hexdigest()


class _Node:
    __slots__ = ("children", "depth", "ends", "least", "leaves", "n", "saved", "words")

    def __init__(self, depth: int, words: int):
        self.depth, self.words, self.n, self.least, self.leaves, self.saved, self.ends, self.children = depth, words, 0, None, 0, 0, _EMPTY, []

    def row(self, parent) -> tuple:
        return self.least, self.depth, parent, self.n, len(self.children), self.leaves, self.saved, self.ends

    def close(self, out: list) -> tuple:
        """What the parent keeps of a complete node; its children's rows go out, as their parent is known."""
        self.leaves += not self.children
        self.saved += (self.n - 1) * self.words
        out.extend((least, depth, self.least, *rest) for least, depth, *rest in self.children)
        return self.least, self.depth, self.n, len(self.children), self.leaves, self.saved, self.ends


def _sweep(batches):
    """Nodes of sorted containers. A container's top comes without parent, with its head and its words."""
    import pyarrow as pa

    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in NODE.split(", ")] + [("head", pa.string()), ("path", pa.string()), ("words", pa.list_(pa.int32()))])
    head, path, top_words, stack, out = None, "", [], [], []

    def up():
        kept = stack[-1].close(out)
        node = stack.pop()
        above = stack[-1]
        above.n, above.leaves, above.saved = above.n + node.n, above.leaves + node.leaves, above.saved + node.saved
        above.least = node.least if above.least is None else min(above.least, node.least)
        above.children.append(kept)

    def finish():
        while len(stack) > 1:
            up()
        top = stack.pop()
        least, depth, *rest = top.close(out)
        out.append((least, depth, None, *rest, head, path[: depth * ID], top_words[:depth]))

    def flush():
        rows = [r if len(r) == 11 else (*r, None, None, None) for r in out]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for new_head, new_path, words, n, least, ends, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if new_head != head or not stack:
                if stack:
                    finish()
                head, top_words = new_head, words
                stack.append(_Node(depth, words[depth - 1] if depth else 0))
                same = depth
            else:
                same = depth
                while new_path[same * ID : same * ID + ID] == path[same * ID : same * ID + ID] != "":
                    same += 1
                while stack[-1].depth > same:
                    up()
            for d in range(same + 1, len(words) + 1):
                stack.append(_Node(d, words[d - 1]))
            path, node = new_path, stack[-1]
            node.n, node.ends = node.n + n, ends
            node.least = least if node.least is None else min(node.least, least)
        if out:
            yield flush()
    if stack:
        finish()
    if out:
        yield flush()


def nodes(every: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The trie's nodes from the distinct sequences."""
    bounded_batches(every.sparkSession)
    held = stored(burst(every, max(1, limit)))
    contained = held.where("not inner").select("head", "path", "words", "n", "least", "ends", "depth")
    swept = stored(contained.repartition("head").sortWithinPartitions("head", "path").mapInArrow(_sweep, f"{NODE}, head string, path string, words array<int>"))
    names = [c.split()[0] for c in NODE.split(", ")]
    tops = swept.where("path is not null")
    # inner nodes: what containers and the sequences that end on the way give to each of their heads
    steps = lambda last: F.explode(F.sequence(F.lit(0), F.col("depth").cast("int") - last)).alias("at")
    gives = ["n", "least", "leaves", "saved"]
    of_tops = tops.where("depth > 0").select("path", "words", "depth", F.col("n_convs").alias("n"), F.col("conv_id").alias("least"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), steps(1))
    of_tops = of_tops.select("path", "words", "at", *gives, (F.col("at") == F.col("depth") - 1).cast("long").alias("children"), F.lit(None).cast("string").alias("ends"))
    of_ended = held.where("inner").select("path", "words", "depth", "n", "least", "ends", steps(0))
    of_ended = of_ended.select("path", "words", "at", "n", "least", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("children"), F.when(F.col("at") == F.col("depth"), F.col("ends")).alias("ends"))
    given = of_tops.unionByName(of_ended).withColumn("path", _head("at")).withColumn("word", F.when(F.col("at") > 0, F.element_at("words", F.greatest(F.col("at"), F.lit(1)))).otherwise(0))
    sums = [F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum("children").alias("children"), F.max("ends").alias("ends"), F.first("word").alias("word"), F.first("at").alias("at"), F.first("path").alias("path")]
    inner = stored(given.groupBy(F.md5("path").alias("node")).agg(*sums))
    own = (F.col("n") - 1) * F.col("word")
    up = inner.select("path", own.alias("own"), "at", F.explode(F.sequence(F.lit(0), F.col("at"))).alias("to"))
    up = up.select(F.md5(_head("to")).alias("node"), "own", (F.col("to") == F.col("at") - 1).cast("long").alias("child"))
    more = up.groupBy("node").agg(F.sum("own").alias("own"), F.sum("child").alias("child"))
    parent = F.when(F.col("at") > 0, F.md5(F.substring("path", F.lit(1), (F.col("at") - 1) * ID)))
    heads = inner.join(more, "node").select("node", parent.alias("parent"), F.col("least").alias("conv_id"), F.col("at").cast("long").alias("depth"), F.col("n").alias("n_convs"), (F.col("children") + F.col("child")).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + F.col("own")).alias("saved_tokens"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"))
    parents = inner.select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"))
    below = heads.drop("node").unionByName(tops.select(F.when(F.col("depth") > 0, F.md5(F.substring("path", F.lit(1), ((F.col("depth") - 1) * ID).cast("int")))).alias("parent"), *[n for n in names if n != "parent_conv_id"]))
    below = stored(below)
    common = hot_keys(below.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n")), ["parent"])
    known = join_hot(below.where("parent is not null"), parents, ["parent"], stored(common), "left").select(names)
    root = below.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(names)
    return swept.where("path is null").select(names).unionByName(known).unionByName(root)


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the trie
    of rebuilt conversations."""
    return nodes(stored(sequences(rebuilt(turns(conversations)))), limit)


SQL = r"""
WITH r AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list(md5(strlen(role) || ':' || role || text) ORDER BY i) AS ids, list(CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) ORDER BY i) AS words FROM r GROUP BY conv_id
), bytes AS (SELECT conv_id, k, CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(k AS INTEGER), 1)) AS BIGINT) AS b FROM c, unnest(range(1, length(CAST(conv_id AS VARCHAR)) + 1)) AS u(k)),
crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list(b ORDER BY k)), lambda x, y:
    list_reduce(list_prepend(xor(x, y), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda p, q: xor(p >> 1, (p & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM bytes GROUP BY conv_id
), built AS (
  SELECT c.conv_id, list_concat(coalesce(b.ids[1:h], []), c.ids[h + 1:]) AS ids, list_concat(coalesce(b.words[1:h], []), c.words[h + 1:]) AS words
  FROM c JOIN crc USING (conv_id) LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, d, len(ids) AS n, array_to_string(ids[1:d], '') AS node, CASE WHEN d > 0 THEN array_to_string(ids[1:d - 1], '') END AS parent, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w
  FROM built, unnest(range(0, len(ids) + 1)) AS u(d)
), nodes AS (
  SELECT node, any_value(d) AS d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM prefixes GROUP BY node
), kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
up AS (SELECT substr(n.node, 1, CAST(32 * u.d AS INTEGER)) AS node, own, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf FROM nodes n LEFT JOIN kids USING (node), unnest(range(0, n.d + 1)) AS u(d)),
sums AS (SELECT node, sum(own) AS saved_tokens, sum(leaf) AS n_leaves FROM up GROUP BY node)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids k ON k.node = n.node JOIN sums s ON s.node = n.node
"""
