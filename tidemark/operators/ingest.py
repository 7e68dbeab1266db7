"""From raw records to facts: normalisation, admission, exclusion, and de-duplication or upsert by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.scratch import cut

# Other names under which a field of a raw record may come.
ALIASES = {
    "source_trade_id": ("id", "trade_id", "tradeId"), "transaction_hash": ("transaction_hash", "transactionHash"), "proxy_wallet": ("proxy_wallet", "proxyWallet"),
    "condition_id": ("condition_id", "conditionId"), "asset_id": ("asset_id", "token_id", "tokenId", "asset"), "side": ("side",), "price": ("price",), "size": ("size",),
    "timestamp": ("timestamp", "trade_ts"), "title": ("title",), "slug": ("slug",), "event_slug": ("event_slug", "eventSlug"),
    "outcome_name": ("outcome", "outcome_name"), "outcome_index": ("outcome_index", "outcomeIndex"),
}


def normalize_trades(raw: DataFrame) -> DataFrame:
    """One row per raw record, with is_malformed instead of an error. Missing fields may be absent as columns."""
    present = set(raw.columns)
    pick = {k: F.coalesce(*[F.col(f"`{a}`").cast("string") for a in names if a in present], F.lit(None).cast("string")) for k, names in ALIASES.items()}
    text = {k: F.coalesce(pick[k], F.lit("")) for k in ("transaction_hash", "asset_id", "title", "slug", "event_slug", "outcome_name")}
    text |= {k: F.lower(F.coalesce(pick[k], F.lit(""))) for k in ("proxy_wallet", "condition_id")} | {"side": F.upper(F.coalesce(pick["side"], F.lit("")))}
    rows = raw.select(
        pick["source_trade_id"].alias("source_trade_id"), *[c.alias(k) for k, c in text.items()], pick["price"].alias("price"), pick["size"].alias("size"),
        pick["timestamp"].try_cast("bigint").alias("trade_ts"), pick["outcome_index"].try_cast("int").alias("outcome_index"),
    )
    # The input's own scale of price and size is part of the key.
    print_ = S.fingerprint("transaction_hash", "proxy_wallet", "condition_id", "asset_id", "trade_ts", "side", "price", "size")
    rows = rows.withColumns({"price_ppm": S.millionths("price"), "size_microshares": S.millionths("size"), "notional_microusd": S.notional("price", "size"), "fingerprint": print_})
    bad = (F.col("proxy_wallet") == "") | (F.col("condition_id") == "") | (F.col("asset_id") == "") | (F.col("side") == "") | (F.coalesce("trade_ts", F.lit(0)) == 0) | F.col("notional_microusd").isNull()
    return rows.withColumns({"trade_key": S.trade_key(F.col("source_trade_id"), F.col("fingerprint")), "is_malformed": bad})


def page_items(pages: DataFrame, body: str, item_schema: str) -> DataFrame:
    """Items and next cursor of JSON envelopes: data as a list, or data.items or data.rows."""
    # An object read as a list would be a list of one, so only lists are read.
    found = [F.get_json_object(body, p) for p in ("$.data", "$.data.items", "$.data.rows")]
    items = [F.when(x.startswith("["), F.from_json(x, f"array<{item_schema}>")) for x in found]
    cursor = F.coalesce(F.get_json_object(body, "$.next_cursor"), F.get_json_object(body, "$.nextCursor"))
    return pages.select(cursor.alias("next_cursor"), F.explode(F.coalesce(*items)).alias("item")).select("next_cursor", "item.*")


def backfill_markets(markets: DataFrame, excluded: DataFrame, end: int) -> DataFrame:
    """Markets to scan: with an id, not excluded, and not created after the window."""
    return markets.where(F.col("condition_id").isNotNull() & F.coalesce(F.col("created_ts") <= end, F.lit(True))).join(excluded.select("condition_id"), "condition_id", "left_anti")


def admit(trades: DataFrame, start: int | None = None, end: int | None = None, least: int = 100 * S.MILLION) -> DataFrame:
    """Buys of at least ``least`` within the window, both ends included."""
    kept = trades.where((F.col("side") == "BUY") & (F.col("notional_microusd") >= least))
    return kept if start is None else kept.where(F.col("trade_ts").between(start, end))


def without_excluded(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return rows.join(excluded.select(key), key, "left_anti")


def first_wins(rows: DataFrame, keys: list[list[str]], order: list[Column | str]) -> DataFrame:
    """Insert-or-ignore under several unique keys: in order, a row stays if no row that stayed has one of its keys.

    A null in a key is no conflict. One key is one aggregate, so a hot key is reduced before the shuffle. Under several
    keys, rows that are first in all their keys stay, rows that share a key with these go, and what is left goes round
    again; only rows in some conflict take part in that.
    """
    names = rows.columns
    place = F.struct(*[(F.expr(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)], F.xxhash64(*names).alias("h"))
    if len(keys) == 1:
        key = keys[0]
        whole = F.col(key[0]).isNotNull()
        for k in key[1:]:
            whole = whole & F.col(k).isNotNull()
        rest = [c for c in names if c not in key]
        top = rows.where(whole).groupBy(*key).agg(F.min_by(F.struct(*(rest or [F.lit(0).alias("_")])), place).alias("_r"))
        return top.select(*key, *([f"_r.`{c}`" for c in rest])).select(*names).unionByName(rows.where(~whole))
    held = [F.when(F.concat(*[F.col(k).cast("string") for k in key]).isNotNull(), F.struct(*key)) for key in keys]
    left = cut(rows.select(F.struct(*names).alias("row"), place.alias("o"), F.monotonically_increasing_id().alias("id"), *[h.alias(f"k{i}") for i, h in enumerate(held)]))
    kept = []
    while True:
        marked = left
        for i in range(len(keys)):
            least = left.where(f"k{i} is not null").groupBy(f"k{i}").agg(F.min(F.struct("o", "id")).alias(f"m{i}"))
            marked = marked.join(least, f"k{i}", "left")
        first = cut(marked.withColumn("first", F.forall(F.array(*[F.col(f"m{i}").isNull() | (F.col(f"m{i}.id") == F.col("id")) for i in range(len(keys))]), lambda x: x)).drop(*[f"m{i}" for i in range(len(keys))]))
        stays = first.where("first")
        kept.append(stays.select("row.*"))
        rest = first.where("not first")
        for i in range(len(keys)):
            rest = rest.join(stays.where(f"k{i} is not null").select(f"k{i}").distinct(), f"k{i}", "left_anti")
        left = cut(rest.drop("first"))
        if not left.take(1):
            return reduce(DataFrame.unionByName, kept).select(*names)


def latest_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a partial aggregate, so that a hot key is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    top = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return top.select(*key, "_r.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_old_if_null: list[str] = []) -> DataFrame:  # noqa: B006
    """new over old by key; the named columns keep the old value where the new one is null."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full")
    is_new = F.col(f"n.{key[0]}").isNotNull()
    value = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in key or c in keep_old_if_null else F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*[value(c).alias(c) for c in old.columns])
