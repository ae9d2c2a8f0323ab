"""Golden records: one surviving record for each cluster of customer records.

A field's value comes from the first record, in the field's own order, that has one:

- RECENT: latest update (none last), higher trust, smaller id.
- TRUSTED: fresh before stale, higher trust, then RECENT. A record is stale if it has no update or one over ten days before its cluster's latest.
- segment by RECENT; email by TRUSTED; name by most code points, then TRUSTED; balance from records of the chosen segment before
  all others, then RECENT; city and nation together from the record with most of both, then RECENT, even if they are null.

Map-side dominance pruning. A partition doesn't know a cluster's latest update, so it can't tell which of its records are stale. But
among records of equal trust a fresh one is more recent than a stale one, so RECENT puts them in TRUSTED's order whatever
the latest update is. Each block of a partition's rows hence keeps, of each cluster, the winner of a few slots and no other record: the segment's, an email's
and a name's for each level of trust, a balance's for each segment, and the address. Whatever wins in the whole
cluster has won its slot in its own block. Beside them stand the block's counts: records, latest update, records that are stale in any case
(without an update, or ten days before the block's own latest), and the other updates, each with its number.

Only survivors are shuffled. Those of clusters with many rows in a block are pruned once more, dealt by cluster and salt, so that what
a cluster of any size brings to one group is slots times salts. Updates are held against the clusters' latest in a join whose crowded
partitions Spark may split, and are summed by block before they are grouped. Survivors and counts then meet in grouped pandas, many clusters to a group, in
groups whose number follows the rows'. Blocks' survivors are Parquet in the shared folder, which stays for the caller to remove.

Results in special cases: strings of white space are null; a source that is none of the four, or null, has the least
trust; a balance that is not a finite number is null; rows without both ids are one cluster, whose id is null; a null id
comes last among equals, and an id that gave a value is null if it is; rows alike in update, trust and id are put in order of their values, so that
the result is the same however rows are dealt; repeated rows count each; ids may be of any type that sorts; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import arrow_map
from lodestone.shared import shared_folder

#: Sources by falling trust.
TRUST = ("store", "crm", "partner", "web")
#: Ten days in microseconds, and the update of a record without one.
STALE_AFTER, NEVER = 10 * 24 * 3600 * 1_000_000, np.iinfo(np.int64).min
#: Rows of a block that is pruned at once; a cluster's rows in a block from which its survivors are pruned again, and the salts they are dealt by.
BLOCK, CROWDED, SALTS = 100_000, 64, 16
#: Survivors of a group of clusters.
GROUP = 20_000

VALUES = ("segment", "name", "email", "city", "nation_id", "balance")
KEY = ("no_cluster", "cluster_id")


def _records(df: DataFrame) -> DataFrame:
    """The columns that count, ids without nulls beside flags, blank strings as null, a balance in cents."""
    blank = lambda c: F.when(F.col(c).rlike(r"[^\x20\x09-\x0D]"), F.col(c)).alias(c)
    cluster = F.coalesce("master_id", "client_id")
    filled = lambda c: F.coalesce(c, F.lit(0).cast(df.schema["client_id"].dataType))
    trust = F.coalesce(*(F.when(F.col("source") == s, F.lit(k)) for k, s in enumerate(TRUST)), F.lit(len(TRUST)))
    cents = F.floor(100 * F.col("balance") + 0.5)
    finite = ~F.isnan("balance") & (F.abs("balance") < 9e16)
    return df.select(
        cluster.isNull().alias("no_cluster"), filled(cluster).alias("cluster_id"), F.isnull("client_id").alias("no_client"), filled(F.col("client_id")).alias("client_id"),
        F.col("updated_at").alias("at"), trust.cast("int").alias("trust"), *map(blank, ("segment", "name", "email", "city")), F.col("nation_id").cast("long").alias("nation_id"), F.when(finite, cents).cast("long").alias("balance"),
    )


def _codes(*columns: pa.Array) -> np.ndarray:
    """Equal numbers for rows equal in all columns; a null equals a null."""
    out = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        coded = c.dictionary_encode(null_encoding="encode")
        out = np.unique(out * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return out


def _ranked(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows by cluster and RECENT, and each row's cluster."""
    cluster = _codes(table["no_cluster"].combine_chunks(), table["cluster_id"].combine_chunks())
    client = pc.rank(table["client_id"].combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
    keys = (client, table["no_client"].to_numpy(), table["trust"].to_numpy(), ~table["at"].to_numpy(), cluster)
    order = np.lexsort(keys)
    same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    if same.any():  # put rows alike in all of these in the order of their values first
        values = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in VALUES]).to_numpy()
        order = values[np.lexsort(tuple(k[values] for k in keys))]
    return table.take(pa.array(order)), cluster[order]


def _first(rows: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Of the given rows, in their order, the first of each group."""
    group = np.zeros(len(rows), dtype=np.int64)
    for k in keys:
        group = np.unique(group * (int(k.max(initial=0)) + 1) + k[rows], return_inverse=True)[1]
    return rows[np.unique(group, return_index=True)[1]]


def _winners(table: pa.Table, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, in rows by cluster and RECENT, of all slots' winners; and those of the addresses alone, one for each cluster."""
    has = {c: table[c].is_valid().to_numpy() for c in VALUES}
    trust = table["trust"].to_numpy()
    segment = _codes(table["segment"].combine_chunks())
    length = pc.fill_null(pc.utf8_length(table["name"]), 0).to_numpy()
    best = lambda rows, by: rows[np.argsort(-by[rows], kind="stable")]
    named, every = np.flatnonzero(has["name"]), np.arange(len(cluster))
    address = _first(best(every, has["city"].astype(int) + has["nation_id"]), cluster)
    found = [_first(np.flatnonzero(has["segment"]), cluster), _first(np.flatnonzero(has["email"]), cluster, trust), _first(best(named, length), cluster, trust), _first(np.flatnonzero(has["balance"]), cluster, segment)]
    return np.unique(np.concatenate([address, *found])), address


#: Of a block's clusters, on their address's row: records, those that are stale in any case, the latest update, and the other updates with their numbers.
COUNTS = ["n", "late", "latest", "times", "time_n"]
_COUNTS = "n long, late long, latest long, times array<long>, time_n array<int>"


def _counts(table: pa.Table, cluster: np.ndarray, rows: np.ndarray) -> list[pa.Array]:
    """The counts of a block's clusters, and nothing on the other survivors' rows: ``rows`` holds, for each survivor, its cluster or -1."""
    at = table["at"].to_numpy()
    starts = np.flatnonzero(np.diff(cluster, prepend=-1))
    sizes = np.diff(np.append(starts, len(cluster)))
    latest = at[starts]  # RECENT puts it first
    bound = np.where(latest == NEVER, NEVER, np.maximum(latest, NEVER + STALE_AFTER + 1) - STALE_AFTER)
    late = (at == NEVER) | (at < np.repeat(bound, sizes))
    n_late = np.add.reduceat(late, starts) if len(starts) else np.zeros(0, dtype=np.int64)
    fresh = np.flatnonzero(~late)  # falling updates of each cluster: equal ones stand together
    new = np.ones(len(fresh), dtype=bool)
    new[1:] = (at[fresh][1:] != at[fresh][:-1]) | (cluster[fresh][1:] != cluster[fresh][:-1])
    times = at[fresh][new]
    time_n = np.diff(np.append(np.flatnonzero(new), len(fresh))).astype(np.int32)
    per = np.bincount(np.searchsorted(starts, fresh[new], side="right") - 1, minlength=len(starts))
    # one row for each survivor; clusters are numbered in order of ``starts``
    own = rows >= 0
    place = np.where(own, rows, 0)
    number = lambda x: np.where(own, x[place], 0) if len(x) else np.zeros(len(rows), dtype=np.int64)
    width = number(per)
    begin = np.concatenate(([0], np.cumsum(per)))[:-1] if len(per) else per
    take = np.repeat(number(begin) - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
    offsets = pa.array(np.concatenate(([0], np.cumsum(width))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[take])) for x in (times, time_n)]
    return [pa.array(number(sizes)), pa.array(number(n_late).astype(np.int64)), pa.array(np.where(own, number(latest), NEVER)), *lists]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _micros(table: pa.Table) -> pa.Table:
    at = pc.fill_null(table["at"].cast(pa.int64()), NEVER)  # Spark hands over microseconds
    return table.set_column(table.schema.get_field_index("at"), "at", at).combine_chunks()


def prune(records: DataFrame) -> DataFrame:
    """The survivors of every block, ``crowd`` (their cluster's rows in it), and the clusters' counts."""

    def run(batches: Iterator[pa.RecordBatch]):
        for table in map(_micros, _blocks(batches)):
            table, cluster = _ranked(table)
            starts = np.flatnonzero(np.diff(cluster, prepend=-1))
            number = np.repeat(np.arange(len(starts)), sizes := np.diff(np.append(starts, len(cluster))))
            kept, address = _winners(table, cluster)
            counted = np.where(np.isin(kept, address), number[kept], -1)
            out = table.take(pa.array(kept)).append_column("crowd", pa.array(sizes[number[kept]]))
            for name, column in zip(COUNTS, _counts(table, cluster, counted), strict=True):
                out = out.append_column(name, column)
            yield from out.combine_chunks().to_batches(max_chunksize=20_000)

    kinds = ", ".join(f"{f.name} {'long' if f.name == 'at' else f.dataType.simpleString()}" for f in records.schema)
    return arrow_map(records, records.columns, run, f"{kinds}, crowd long, {_COUNTS}")


def _again(survivors: DataFrame) -> DataFrame:
    """Survivors of survivors: of each partition's clusters, block by block."""

    def run(batches: Iterator[pa.RecordBatch]):
        for table in _blocks(batches):
            table, cluster = _ranked(table.combine_chunks())
            yield from table.take(pa.array(_winners(table, cluster)[0])).combine_chunks().to_batches()

    return arrow_map(survivors, survivors.columns, run, survivors.schema)


def _stats(pruned: DataFrame) -> DataFrame:
    """Per cluster: records, stale ones, and the latest update."""
    counts = pruned.where("n > 0").select(*KEY, *COUNTS)
    latest = counts.groupBy(*KEY).agg(F.max("latest").alias("cluster_latest"), F.sum("n").alias("n_records"), F.sum("late").alias("n_late"))
    # a cluster in one block knows its latest already; in all others the updates that the block left open are held against it
    open_ = counts.join(latest.select(*KEY, "cluster_latest"), list(KEY)).where("cluster_latest > latest")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            times, n = batch.column(3), batch.column(4)
            at = times.offsets.to_numpy().astype(np.int64)
            at = at - at[0]
            bound = np.repeat(batch.column(2).to_numpy() - STALE_AFTER, np.diff(at))
            stale = np.where(times.flatten().to_numpy() < bound, n.flatten().to_numpy(), 0)
            sums = np.diff(np.concatenate(([0], np.cumsum(stale, dtype=np.int64)))[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums)], names=[*KEY, "more"])

    kind = pruned.schema["cluster_id"].dataType.simpleString()
    more = arrow_map(open_, [*KEY, "cluster_latest", "times", "time_n"], run, f"no_cluster boolean, cluster_id {kind}, more long")
    more = more.where("more > 0").select(*KEY, F.lit(None).cast("long").alias("cluster_latest"), F.lit(0).cast("long").alias("n_records"), F.col("more").alias("n_late"))
    return latest.unionByName(more).groupBy(*KEY).agg(F.max("cluster_latest").alias("latest"), F.sum("n_records").alias("n_records"), F.sum("n_late").alias("n_stale"))


def _chosen(records: pd.DataFrame, stats: pd.DataFrame) -> pd.DataFrame:
    """The golden records of a group's clusters, from survivors and counts."""
    rows = records.merge(stats, on=list(KEY))
    rows["cluster"] = rows.groupby(list(KEY), sort=False).ngroup()
    rows["never"] = rows["at"] == NEVER
    rows["stale"] = rows["never"] | (rows["at"] < rows["latest"] - STALE_AFTER)
    rows["earlier"] = -rows["at"].where(~rows["never"], 0)
    recent = ["never", "earlier", "trust", "no_client", "client_id", *VALUES]
    rows = rows.sort_values(["cluster", *recent], ignore_index=True, na_position="last")
    rows["recent"] = rows.index
    rows["shorter"] = -rows["name"].str.len().fillna(0).astype("int64") if rows["name"].notna().any() else 0
    rows["lacking"] = rows["city"].isna().astype(int) + rows["nation_id"].isna()

    def first(having: pd.Series | None, *order: str) -> pd.DataFrame:
        some = rows if having is None else rows[having]
        return some.sort_values(["cluster", *order, "recent"]).drop_duplicates("cluster").set_index("cluster")

    segment = first(rows["segment"].notna())
    chosen = rows["cluster"].map(segment["segment"])
    rows["other"] = (rows["segment"] != chosen) & ~(rows["segment"].isna() & chosen.isna())
    address = first(None, "lacking")
    picked = {
        "name": first(rows["name"].notna(), "shorter", "stale", "trust"), "email": first(rows["email"].notna(), "stale", "trust"), "segment": segment,
        "balance": first(rows["balance"].notna(), "other"),
    }
    out = address[[*KEY, "n_records", "n_stale", "city", "nation_id"]].copy()
    for c, found in picked.items():
        out[c] = found[c].reindex(out.index)
        out[f"{c}_from"] = found["client_id"].astype(object).where(~found["no_client"], None).reindex(out.index)
    out["address_from"] = address["client_id"].astype(object).where(~address["no_client"] & (address["lacking"] < 2), None)
    out["cluster_id"] = out["cluster_id"].astype(object).where(~out["no_cluster"], None)
    out["balance_cents"] = out["balance"].astype("Int64")
    out["nation_id"] = out["nation_id"].astype("Int64")
    return out.astype(object).where(out.notna(), None)


def golden(df: DataFrame) -> DataFrame:
    """One record for each cluster (``master_id``, else ``client_id``) of ``df``, and the records that its values are from."""
    spark = df.sparkSession
    nation, id_kind = df.schema["nation_id"].dataType.simpleString(), df.schema["client_id"].dataType.simpleString()
    folder = f"{shared_folder(spark)}/golden-{uuid.uuid4().hex}"
    prune(_records(df)).write.option("compression", "zstd").parquet(folder)
    pruned = spark.read.parquet(folder)
    groups = max(1, -(-pruned.count() // GROUP))
    columns = [c for c in pruned.columns if c not in COUNTS]
    crowded = pruned.where(F.col("crowd") >= CROWDED).select(*columns)
    salted = crowded.withColumn("salt", F.pmod(F.xxhash64("client_id", "at"), F.lit(SALTS))).repartition(*KEY, "salt").drop("salt")
    survivors = pruned.where(F.col("crowd") < CROWDED).select(*columns).unionByName(_again(salted)).drop("crowd")
    group = lambda rows: rows.withColumn("group", F.pmod(F.xxhash64(*KEY), F.lit(groups)))
    names = ["cluster_id", "n_records", "n_stale", "name", "email", "segment", "city", "nation_id", "balance_cents", "name_from", "email_from", "segment_from", "balance_from", "address_from"]
    kinds = [id_kind, "long", "long", "string", "string", "string", "string", nation, "long", *[id_kind] * 5]

    def run(records: pd.DataFrame, stats: pd.DataFrame) -> pd.DataFrame:
        return _chosen(records.drop(columns="group"), stats.drop(columns="group"))[names]

    # a long column with nulls reaches pandas as doubles: ids and updates have no nulls, and cents were doubles
    met = group(survivors).groupBy("group").cogroup(group(_stats(spark.read.parquet(folder))).groupBy("group"))
    return met.applyInPandas(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def oracle() -> str:
    """DuckDB SQL for the whole result."""
    blank = lambda c: f"case when regexp_matches({c}, '[^\\x20\\x09-\\x0D]') then {c} end as {c}"
    trust = " ".join(f"when '{s}' then {k}" for k, s in enumerate(TRUST))
    values = ", ".join(f"{c} nulls last" for c in VALUES)

    def first(value: str, having: str, *order: str) -> str:
        return f"arg_min({value}, [{', '.join([*order, 'recent'])}]) filter ({having})"

    named, mailed, priced = ("-length(name)", "stale", "trust"), ("stale", "trust"), ("other",)
    return f"""
        with plain as (
            select coalesce(master_id, client_id) as cluster_id, client_id, updated_at, case source {trust} else {len(TRUST)} end as trust,
                {blank('segment')}, {blank('name')}, {blank('email')}, {blank('city')}, nation_id, cast(floor(100 * balance + 0.5) as bigint) as balance
            from clients
        ), dated as (select *, max(updated_at) over (partition by cluster_id) as latest from plain), ordered as (
            select *, cast(updated_at is null or updated_at < latest - interval 240 hours as int) as stale, cast(city is null as int) + cast(nation_id is null as int) as lacking,
                row_number() over (partition by cluster_id order by updated_at desc nulls last, trust, client_id nulls last, {values}) as recent
            from dated
        ), chosen as (select cluster_id, {first('segment', 'segment is not null')} as chosen from ordered group by cluster_id), rows_ as (
            select o.*, cast(o.segment is distinct from c.chosen as int) as other from ordered o join chosen c on o.cluster_id is not distinct from c.cluster_id
        )
        select cluster_id, count(*) as n_records, sum(stale)::bigint as n_stale, {first('name', 'name is not null', *named)} as name, {first('email', 'email is not null', *mailed)} as email,
            {first('segment', 'segment is not null')} as segment, max(city) filter (addressed) as city, max(nation_id) filter (addressed) as nation_id,
            {first('balance', 'balance is not null', *priced)} as balance_cents, {first('client_id', 'name is not null', *named)} as name_from, {first('client_id', 'email is not null', *mailed)} as email_from,
            {first('client_id', 'segment is not null')} as segment_from, {first('client_id', 'balance is not null', *priced)} as balance_from, max(client_id) filter (addressed and lacking < 2) as address_from
        from (select *, row_number() over (partition by cluster_id order by lacking, recent) = 1 as addressed from rows_)
        group by cluster_id"""
