"""N-gram Jaccard join (operator 7): prefix filters under several global orders.

If two sets of sizes m and n have Jaccard similarity of t or more, then under any one order of all tokens
the first n - ceil(t n) + l tokens of one and the first m - ceil(t m) + l of the other have l in common.
Each order gives such a filter; a pair must pass them all before it is verified.

* First order (by hash), all documents, l > 1: a document needs tokens that another one has, too, in its
  prefix. Most documents have none or few and are done.
* Second order (rarest first), the documents left, with true frequencies: a document needs t of its
  tokens shared. Orders that rank equally frequent tokens differently give three prefixes per document;
  candidates must share a token in each of them.
* Sets linked to one pivot are connected already, and Jaccard distance is a metric, so clusters are compared
  only where the distances to their pivots allow a link, a set with a chunk of a cluster at a time.
  So no group of copies is expanded into all its pairs, and no link between clusters is lost.

Equal sets are one class throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .store import Workspace, fresh_names, in_document_order, shuffle_width
from .token_counts import byte_slices

U = np.uint64
SHINGLE = 5
#: Share of a set that the first filter wants in common beyond a single token (l = EXTRA * n).
EXTRA = 0.125
ORDERS = 3
#: Members of a cluster, and sets that ask for it, that are counted at once.
CHUNK = 500
#: Single sets of a list up to which their pairs are listed before they are counted; beyond, they are counted where
#: they meet, in blocks of CHUNK by CHUNK. The links are the same.
MANY = 50
#: Clusters of a list that stand in one array.
LIST = 1000


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with a partner: ceil(t n)."""
    return -(-n * percent // 100)


def _first_filter(percent: int):
    """Per row of docs: ord, n, class (c1, c2), `own`: prefix tokens already known to be shared, `send`: prefix
    tokens to look up, `show`: tokens that are shared here, shown to other batches by two witnesses.

    Of the equal sets of a batch one carries the tokens.
    """

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                values, bounds = K.shingle_sets(batch.column("text"), SHINGLE)
                n = np.diff(bounds)
                rows = len(n)
                c1 = _sums(K.mix(values ^ U(0x5851F42D4C957F2D)), bounds)
                c2 = _sums(K.mix(values + U(0x14057B7EF767814F)), bounds)
                ords = batch.column("ord").to_numpy()
                classes, first, back = np.unique(np.stack([c1, c2], axis=1), axis=0, return_index=True, return_inverse=True)
                carries = np.zeros(rows, bool)
                carries[first] = True
                owner = np.repeat(np.arange(rows), n)
                rank = np.arange(len(values)) - bounds[owner]
                prefix = n - _need(n, percent) + np.ceil(EXTRA * n).astype(np.int64)
                chosen = carries[owner] & (rank < prefix[owner])
                token, owner = values[chosen], owner[chosen]
                order = np.lexsort((owner, token))
                token, owner = token[order], owner[order]
                opens = np.ones(len(token), bool)
                opens[1:] = token[1:] != token[:-1]
                group = np.cumsum(opens) - 1
                count = np.bincount(group)[group] if len(group) else group
                shared = count > 1
                closes = np.append(opens[1:], True) if len(opens) else opens
                show = shared & (opens | closes)
                lists = []
                for mask in (~shared, show):
                    at = np.argsort(owner[mask], kind="stable")
                    sizes = np.bincount(owner[mask], minlength=rows)
                    lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(token[mask][at].view(np.int64))))
                own = np.bincount(owner[shared], minlength=rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ord"), batch.column("doc_id"), batch.column("content"), pa.array(n), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(carries), pa.array(own.astype(np.int64)), *lists],
                    names=["ord", "doc_id", "content", "n", "c1", "c2", "carries", "own", "send", "show"],
                )

    return run


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _shared_tokens(batches):
    """From (token, c1, ord) sorted: the ords of rows whose token another class has, too. A null ord is a witness.

    A token's rows may run over batches. Only rows of its first class wait for the next batch, and only until
    another class comes: a row for each slice of texts that holds a copy of one text."""
    token_before, first_class, differs, waiting = None, None, False, []

    def found(ords):
        names, count = np.unique(ords, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(count.astype(np.int64))], names=["ord", "found"])

    for batch in batches:
        token, c1, ord_ = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).fill_null(-1).to_numpy()
        if not len(token):
            continue
        opens = np.ones(len(token), bool)
        opens[1:] = token[1:] != token[:-1]
        group, first = np.cumsum(opens) - 1, c1[opens]
        goes_on = token_before is not None and token[0] == token_before
        if goes_on:
            first[0] = first_class
        several = np.bincount(group, weights=c1 != first[group]) > 0
        if goes_on and differs:
            several[0] = True
        if waiting and goes_on and several[0]:
            yield found(np.concatenate(waiting))
        yield found(ord_[several[group] & (ord_ >= 0)])
        last = group[-1]
        if not goes_on or last or several[0]:
            waiting = []
        if not several[last]:
            waiting.append(ord_[(group == last) & (ord_ >= 0)])
        token_before, first_class, differs = token[-1], first[last], bool(several[last])


def _whole_sets(batches):
    for whole in batches:
        for batch in byte_slices(whole, "text"):
            values, bounds = K.shingle_sets(batch.column("text"), SHINGLE)
            tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("ord"), tokens], names=["ord", "tokens"])


def _prefixes(percent: int):
    """set (shared tokens), and the prefix of shared tokens under each order; sets that can have no partner go."""

    def run(batches):
        for batch in batches:
            out = []
            for ord_, n, shared in zip(batch.column("ord").to_pylist(), batch.column("n").to_pylist(), batch.column("shared"), strict=True):
                need = -(-n * percent // 100)
                flat = shared.values
                token, often = flat.field("token").to_numpy(), flat.field("often").to_numpy()
                length = n - need + 1 - (n - len(token))  # tokens that no other has come first in each order
                if length <= 0:
                    continue
                t = token.view(U)
                ranks = (np.lexsort((t, often)), np.lexsort((K.mix(t), often)), np.lexsort((K.mix(t ^ U(0xABCDEF)), np.log2(often).astype(int))))
                out.append((ord_, n, np.sort(token).tolist(), *(token[r[:length]].tolist() for r in ranks)))
            names = ["ord", "n", "tokens", *[f"p{i}" for i in range(ORDERS)]]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * (ORDERS + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, filtered: bool = False) -> DataFrame:
    """u, v, both (tokens in common), either (of one or the other) of each pair; filtered: of those only that share
    a prefix token under every order."""
    orders = [f"p{i}" for i in range(ORDERS)] if filtered else []
    left, right = (sets.select(F.col("ord").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}"), *[F.col(p).alias(f"{p}{c}") for p in orders]) for c in "uv")
    held = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v")
    for p in orders:
        held = held.filter(F.arrays_overlap(f"{p}u", f"{p}v"))
    both = F.size(F.array_intersect("tu", "tv")).cast("bigint")
    return held.select("u", "v", both.alias("both"), (F.col("nu") + F.col("nv") - both).alias("either"))


def _meeting(asking: DataFrame, met: DataFrame, larger: bool) -> DataFrame:
    """v, us: for each asking cluster v the met clusters of other groups that share a list with it.

    Both: token, lead, label, members. larger: met clusters have several members; a single set asks all of them, else
    a pair is made from its larger name only. A list's clusters are an array for each LIST of them, and a cluster gets
    the arrays of its own lists, so a pair is made once however many lists it shares."""
    parts = met.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / LIST).alias("parts"))
    dealt = met.join(parts, "token").withColumn("part", F.pmod(F.xxhash64("lead"), "parts"))
    lists = dealt.groupBy("token", "part").agg(F.collect_list(F.struct(F.col("lead").alias("u"), F.col("label").alias("gu"))).alias("found"))
    asked = asking.select("token", F.col("lead").alias("v"), F.col("label").alias("gv"), F.col("members").alias("mv"))
    wanted = F.filter("found", lambda x: (x["gu"] != F.col("gv")) & ((F.lit(larger) & (F.col("mv") == 1)) | (x["u"] < F.col("v"))))
    others = asked.join(lists, "token").select("v", F.transform(wanted, lambda x: x["u"]).alias("us")).filter(F.size("us") > 0)
    return others.groupBy("v").agg(F.array_distinct(F.flatten(F.collect_list("us"))).alias("us"))


def _best_link(percent: int):
    """For each asking set the nearest linked member of a chunk, if any: members of a cluster are connected already,
    so one link with them is enough."""

    def run(asking: pa.Table, members: pa.Table) -> pa.Table:
        out = []
        if asking.num_rows and members.num_rows:
            lists = members["tokens"].combine_chunks()
            flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(members.num_rows), np.diff(lists.offsets.to_numpy()))
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            names, sizes = members["ord"].to_numpy(), members["n"].to_numpy()
            for name, n, tokens in zip(asking["ord"].to_pylist(), asking["n"].to_pylist(), asking["tokens"].combine_chunks(), strict=True):
                t = tokens.values.to_numpy()
                lo, hi = np.searchsorted(flat, t, "left"), np.searchsorted(flat, t, "right")
                width = hi - lo
                at = np.repeat(lo - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
                both = np.bincount(owner[at], minlength=len(names))
                either = n + sizes - both
                best = int(np.argmax(both / either))
                if 100 * both[best] >= percent * either[best] and names[best] != name:
                    out.append((name, int(names[best]), int(both[best]), int(either[best])))
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("u", "v", "both", "either"), columns, strict=True)})

    return run


#: Columns of a table of lists against tables of one block that are dense at once.
DENSE = 4096


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a column of lists."""
    lists = table[name].combine_chunks()
    return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])


def _overlap(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], below: int | None = None) -> np.ndarray:
    """Whether each list of x shares a value with each of y; below: of those values only."""
    names = np.intersect1d(x[0], y[0])
    names = names if below is None else names[names < below]
    out = np.zeros((len(x[1]) - 1, len(y[1]) - 1), bool)
    for lo in range(0, len(names), DENSE):
        some, held = names[lo : lo + DENSE], []
        for flat, bounds in (x, y):
            at = np.minimum(np.searchsorted(some, flat), len(some) - 1)
            known = some[at] == flat
            dense = np.zeros((len(bounds) - 1, len(some)), np.float32)
            dense[np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[known], at[known]] = 1
            held.append(dense)
        out |= held[0] @ held[1].T > 0
    return out


def _links_of_list(percent: int):
    """Linked pairs of single sets of different groups, of one part of a list and another. Two sets that share several
    long lists are counted at the least of them, and only if they share a prefix token under every order."""

    def run(below: pa.Table, above: pa.Table) -> pa.Table:
        out = []
        if below.num_rows and above.num_rows:
            (u, gu, nu), (v, gv, nv) = ([t[c].to_numpy() for c in ("lead", "label", "n")] for t in (below, above))
            asks = gu[:, None] != gv
            if below["i"][0].as_py() == below["j"][0].as_py():
                asks &= u[:, None] < v
            asks &= 100 * np.minimum(nu[:, None], nv) >= percent * np.maximum(nu[:, None], nv)
            if asks.any():
                asks &= ~_overlap(_flat(below, "lists"), _flat(above, "lists"), below["token"][0].as_py())
            for i in range(1, ORDERS):
                if asks.any():
                    asks &= _overlap(_flat(below, f"p{i}"), _flat(above, f"p{i}"))
            (mine, ends), (flat, bounds) = _flat(below, "tokens"), _flat(above, "tokens")
            names, place = np.unique(flat, return_inverse=True)
            mark = np.zeros(len(names), np.int64)
            for row in np.flatnonzero(asks.any(axis=1)).tolist():
                tokens = mine[ends[row] : ends[row + 1]]
                known = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
                known = known[names[known] == tokens]
                mark[known] = 1
                met = np.flatnonzero(asks[row])
                width = bounds[met + 1] - bounds[met]
                at = np.repeat(bounds[met] - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
                counts = np.concatenate([[0], np.cumsum(mark[place[at]])])
                both = np.diff(counts[np.concatenate([[0], np.cumsum(width)])])
                mark[known] = 0
                either = nu[row] + nv[met] - both
                linked = 100 * both >= percent * either
                out += [(int(u[row]), *x) for x in zip(v[met][linked].tolist(), both[linked].tolist(), either[linked].tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("u", "v", "both", "either"), columns, strict=True)})

    return run


def links_between(docs: DataFrame, space: Workspace, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(documents, links). documents: ord, doc_id, content, n, rep (least ord of the class, null for an empty set);
    links: u, v, both, either between class representatives, enough of them to connect all that are linked."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    ordered, _ = in_document_order(docs, space)
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = ordered.mapInArrow(_first_filter(percent), f"ord bigint, doc_id {kind}, content bigint, n bigint, c1 bigint, c2 bigint, carries boolean, own bigint, send array<bigint>, show array<bigint>")
    first = space.keep(first, "first")
    classes = first.filter("n > 0").groupBy("c1", "c2").agg(F.min("ord").alias("rep"))
    classes = space.keep(classes, "classes", small=True)

    asked = first.select(F.explode("send").alias("token"), "c1", "ord").unionByName(first.select(F.explode("show").alias("token"), "c1", F.lit(None).cast("bigint").alias("ord")))
    sorted_ = asked.repartition(width, "token").sortWithinPartitions("token", "c1")
    found = sorted_.mapInArrow(_shared_tokens, "ord bigint, found bigint").groupBy("ord").agg(F.sum("found").alias("found"))
    found = space.keep(found, "found", small=True)
    extra = F.ceil(0.75 * EXTRA * F.col("n")) if percent == 75 else F.ceil(percent / 100 * EXTRA * F.col("n"))
    small = first.filter("carries and n > 0").select("ord", "n", "c1", "c2", "own")
    passed = small.join(found.hint("merge"), "ord", "left").filter(F.col("own") + F.coalesce("found", F.lit(0)) >= F.greatest(F.lit(1), extra)).select("c1", "c2", "n").distinct()
    passed = space.keep(passed.join(classes, ["c1", "c2"]).select(F.col("rep").alias("ord"), "n"), "passed", small=True)

    texts = ordered.select("ord", "text").join(passed.select("ord").hint("merge"), "ord", "left_semi")
    whole = space.keep(texts.mapInArrow(_whole_sets, "ord bigint, tokens array<bigint>").dropDuplicates(["ord"]), "whole")
    tokens = whole.select("ord", F.explode("tokens").alias("token"))
    often = space.keep(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "often")
    shared = tokens.join(often.hint("merge"), "token").groupBy("ord").agg(F.collect_list(F.struct("token", "often")).alias("shared"))
    shared = shared.join(passed.hint("merge"), "ord").filter(100 * F.size("shared") >= percent * F.col("n"))
    sets = shared.select("ord", "n", "shared").mapInArrow(_prefixes(percent), "ord bigint, n bigint, tokens array<bigint>, " + ", ".join(f"p{i} array<bigint>" for i in range(ORDERS)))
    sets = space.keep(sets, "sets")
    for name in ("whole", "often"):
        space.drop(name)

    # Each set against the pivot of each of its lists; a pivot is the member with the least hash.
    postings = [sets.select("ord", "n", F.explode(f"p{i}").alias("token")) for i in range(2)]
    near = []
    for i, p in enumerate(postings):
        pivots = p.groupBy("token").agg(F.min(F.struct(F.xxhash64("ord", F.lit(i)).alias("hash"), "ord", "n")).alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("token", "pivot")
        near.append(p.join(pivots, "token").select(F.col("ord").alias("u"), F.col("pivot.ord").alias("v"), F.col("n").alias("nu"), F.col("pivot.n").alias("nv")))
    fits = 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")
    near = near[0].unionByName(near[1]).filter("u <> v").filter(fits).select("u", "v").distinct()
    near = space.keep(_verified(space.keep(near, "near", small=True), sets, filtered=True), "near-verified", small=True)
    linked = 100 * F.col("both") >= percent * F.col("either")
    distance = 1 - F.col("both") / F.col("either")

    # A set's leader: the linked pivot at the least distance, or itself.
    leader = near.filter(linked).groupBy("u").agg(F.min(F.struct(distance.alias("away"), F.col("v").alias("lead"))).alias("l")).select(F.col("u").alias("ord"), "l.away", "l.lead")
    groups = components(near.filter(linked), space, "star").select(F.col("node").alias("ord"), "label")
    placed = sets.select("ord").join(leader, "ord", "left").join(groups, "ord", "left").select("ord", F.coalesce("lead", "ord").alias("lead"), F.coalesce("away", F.lit(0.0)).alias("away"), F.coalesce("label", "ord").alias("label"))
    placed = space.keep(placed, "placed-near", small=True)
    # A pivot may be led by another one, so the only member of a cluster needn't be its pivot. Such a set leads itself:
    # then a cluster of one member bears that member's name.
    lonely = placed.groupBy("lead").agg(F.count(F.lit(1)).alias("members")).filter("members = 1").select("lead", F.lit(True).alias("lonely"))
    own = F.col("lonely").isNotNull()
    placed = placed.join(lonely, "lead", "left").select("ord", F.when(own, F.col("ord")).otherwise(F.col("lead")).alias("lead"), F.when(own, F.lit(0.0)).otherwise(F.col("away")).alias("away"), "label")
    placed = space.keep(placed, "placed", small=True)

    # Seats of clusters in the lists of each order where different groups meet.
    sizes = space.keep(placed.groupBy("lead").agg(F.count(F.lit(1)).alias("members")), "sizes", small=True)
    seatings = space.keep(placed.select("ord", "lead", "label").join(sizes.hint("merge"), "lead"), "seatings", small=True)

    def seats(i):
        every = sets.select("ord", F.explode(f"p{i}").alias("token")).join(seatings.hint("merge"), "ord").select("token", "lead", "label", "members").distinct()
        mixed = every.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.sum((F.col("members") == 1).cast("int")).alias("singles")).filter("least <> most").select("token", "singles")
        return space.keep(every.join(mixed.hint("merge"), "token"), f"seats{i}", small=True)

    seated = [seats(i) for i in range(ORDERS)]
    # A pair of single sets is a candidate if it passes every order. Where few meet, candidates are listed; where many
    # do, two of them share many lists: they are counted at the least of these, and only links leave a block.
    detail = sets.select(F.col("ord").alias("lead"), "n", "tokens", *[f"p{i}" for i in range(1, ORDERS)])
    single = seated[0].filter("members = 1")
    few, many = single.filter(F.col("singles") <= MANY), single.filter(F.col("singles") > MANY).select("token", "lead", "label", "singles")
    parts = F.ceil(F.col("singles") / CHUNK)
    many = many.join(many.groupBy("lead").agg(F.collect_set("token").alias("lists")).hint("merge"), "lead").join(detail.hint("merge"), "lead")
    many = space.keep(many.withColumn("part", F.pmod(F.xxhash64("lead"), parts)).withColumn("last", parts - 1), "many")
    alone = space.keep(_meeting(few, few, larger=False).select(F.explode("us").alias("u"), "v"), "alone", small=True)
    linked_few = _verified(alone, sets, filtered=True).filter(linked)
    # Each part of a list meets itself and the later ones, a block at a time.
    below = many.withColumn("i", F.col("part")).withColumn("j", F.explode(F.sequence("part", "last"))).drop("part", "last")
    above = many.withColumn("j", F.col("part")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), "part"))).drop("part", "last")
    block = ["token", "i", "j"]
    linked_many = below.groupBy(*block).cogroup(above.groupBy(*block)).applyInArrow(_links_of_list(percent), "u bigint, v bigint, both bigint, either bigint")
    alone = space.keep(linked_few.unionByName(linked_many), "alone-links", small=True)
    # Clusters of several members, and any cluster: a link of two of their sets shares a list under every order.
    met = [space.keep(_meeting(s, s.filter("members > 1"), larger=True), f"met{i}") for i, s in enumerate(seated)]
    meet = met[0]
    for following in met[1:]:
        meet = meet.join(following.select("v", F.col("us").alias("also")).hint("merge"), "v").select("v", F.array_intersect("us", "also").alias("us"))
    meet = space.keep(meet.select(F.explode("us").alias("u"), "v"), "meet", small=True)
    meet = space.keep(_verified(meet, sets).withColumn("apart", distance), "meet-verified", small=True)

    # Members of clusters that distances to the pivots don't separate, in blocks: the larger cluster is cut into
    # chunks, and each member of the other one is counted against a whole chunk at once.
    slack = 1 - percent / 100 + 1e-9
    sized = [sizes.select(F.col("lead").alias(c), F.col("members").alias(f"m{c}")) for c in "uv"]
    open_ = meet.filter(F.col("apart") <= 3 * slack).select("u", "v", "apart").join(sized[0], "u").join(sized[1], "v").filter("mu > 1 or mv > 1")
    large = F.col("mu") >= F.col("mv")
    open_ = open_.select(F.when(large, F.col("u")).otherwise(F.col("v")).alias("into"), F.when(large, F.col("v")).otherwise(F.col("u")).alias("lead"), "apart", F.greatest("mu", "mv").alias("size"))
    open_ = space.keep(open_, "open", small=True)
    chunks = F.ceil(F.col("size") / CHUNK)
    held = sets.select("ord", "n", "tokens").join(placed.select("ord", "lead", "away").hint("merge"), "ord")
    into = open_.groupBy("into").agg(F.max("size").alias("size"))
    index = held.join(into.hint("merge"), F.col("lead") == F.col("into")).select("into", F.pmod(F.xxhash64("ord"), chunks).alias("chunk"), "ord", "n", "tokens")
    asking = placed.select("ord", "lead", "away").join(open_, "lead").filter(F.col("apart") - F.col("away") <= 2 * slack)
    asking = space.keep(asking.select("ord", "into", chunks.alias("chunks")), "asks", small=True)
    # Sets that ask for a large cluster are dealt into parts of about CHUNK, each with a copy of its chunks.
    parts = space.keep(asking.groupBy("into").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts")), "parts", small=True)
    asking = asking.join(parts.hint("merge"), "into").select("ord", "into", F.pmod(F.xxhash64("ord"), "parts").alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"))
    asking = asking.join(sets.select("ord", "n", "tokens").hint("merge"), "ord").select("into", "chunk", "part", "ord", "n", "tokens")
    index = index.join(parts.hint("merge"), "into").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    block = ["into", "chunk", "part"]
    asking, index = space.keep(asking, "asking"), space.keep(index, "index")
    rest = asking.groupBy(*block).cogroup(index.groupBy(*block)).applyInArrow(_best_link(percent), "u bigint, v bigint, both bigint, either bigint")
    rest = space.keep(rest, "rest", small=True)
    columns = ["u", "v", "both", "either"]
    links = near.select(columns).unionByName(meet.select(columns)).unionByName(alone.select(columns)).unionByName(rest.select(columns)).filter(linked)
    links = space.keep(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "both", "either").distinct(), "links", small=True)
    documents = first.select("ord", "doc_id", "content", "n", "c1", "c2").join(classes.hint("merge"), ["c1", "c2"], "left").select("ord", "doc_id", "content", "n", F.when(F.col("n") > 0, F.col("rep")).alias("rep"))
    return documents, links


def jaccard_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, content (hash of the text), n_shingles, component_id, ord and least (ord of the document and the least
    ord of its component).

    Sets: distinct shingles of five words, A-Z lower-cased; a text of fewer words is one shingle; a null or
    empty text, or one without words, has an empty set and is its own component. Sets with
    100 * |both| >= percent * |either| are linked. component_id is the least doc_id that links reach, null
    only if none there has an id. Rows with one doc_id and text are one document, each with its row; an empty
    table gives no rows; other columns are ignored.
    """
    space = Workspace(docs.sparkSession, "jaccard", docs)
    documents, links = links_between(docs, space, percent)
    labels = components(links, space, "all")
    documents = space.keep(documents, "documents")
    # The least doc_id of a class, then of a component: both meet in partial minima.
    classes = documents.filter("rep is not null").groupBy("rep").agg(F.min("doc_id").alias("class_id"))
    joined = classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("rep", "class_id", F.coalesce("label", "rep").alias("label"))
    joined = space.keep(joined, "class-labels", small=True)
    ids = joined.groupBy("label").agg(F.min("class_id").alias("component_id"))
    known = space.keep(joined.select("rep", "label").join(ids, "label"), "class-components", small=True)
    space.only("documents", "class-components")
    out = documents.join(known, "rep", "left")
    alone = F.col("rep").isNull()
    return out.select("doc_id", "content", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "ord", F.when(alone, F.col("ord")).otherwise(F.col("label")).alias("least"))


def keep_one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs that come first (by doc_id) in their component, with all their columns. Of equal rows
    with words one stays; rows without words all stay."""
    space = Workspace(docs.sparkSession, "jaccard-kept", docs)
    key, place, id_, content, rows, n = fresh_names(docs, "key", "place", "kept_id", "kept_content", "kept_rows", "kept_n")
    found = jaccard_components(docs, percent)
    kept = found.filter("ord = least").groupBy(F.col("doc_id").alias(id_), F.col("content").alias(content)).agg(F.count(F.lit(1)).alias(rows), F.max("n_shingles").alias(n))
    kept = space.keep(kept, "kept", small=True)
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    joined = keyed.join(kept.hint("merge"), keyed["doc_id"].eqNullSafe(kept[id_]) & (keyed[key] == kept[content]))
    several = (F.col(rows) > 1) & (F.col(n) > 0)
    if not kept.filter(several).limit(1).count():
        return joined.select(*[keyed[c] for c in docs.columns])
    # Only repeated rows are numbered; a row repeated very often costs each task one row at most.
    alike = joined.filter(several).withColumn(place, F.row_number().over(Window.partitionBy(id_, key).orderBy(F.lit(0)))).filter(F.col(place) == 1)
    return joined.filter(~several).select(*docs.columns).unionByName(alike.select(*docs.columns))
