"""Tamper-evident audit logs: hash chains per tenant.

Verification needs only neighbours, so it is one aggregate by (tenant, sequence)
however large a tenant is.  Building a chain is sequential by nature; it is cut
into segments of bounded length that start from an anchor of their own, and the
tails of the segments are chained again, level by level, into a root.

What each part proves: ``check_chain`` finds edited events, broken links,
repeated numbers and every gap that is followed by another event.  An anchor can be
computed by anybody, so a segment that was rewritten as a whole and a log that was
cut at its end look sound on their own; a checkpoint made before signs the number
of events and the root up to its place, and ``verify_checkpoints`` computes both
again.
"""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import stored

# The hash before the first event, and the hashed fields by name.
GENESIS = "0" * 64
EVENT_FIELDS = {
    "client_id": "string",
    "decision": "string",
    "domain": "string",
    "event_id": "string",
    "key_id": "string",
    "latency_ms": "double",
    "method": "string",
    "metric_id": "string",
    "previous_event_hash": "string",
    "resource_uri": "string",
    "sequence_num": "bigint",
    "sql_sha256": "string",
    "tenant_id": "string",
    "timestamp_utc": "double",
    "tool_name": "string",
}
SEGMENT = 256
PLAIN_TEXT = r"^[ !#-\[\]-~]*$"  # printable ASCII without quote and backslash


def _json_number(value: Column) -> Column:
    """The double's own text, as JSON writers give it: 0.0, 1767225600.25, 1e-05, 1.5e+16.

    The text distinguishes any two doubles.  It is written plainly for magnitudes from
    1e-4 to below 1e16.  For the few doubles to which the JVM gives more digits than needed, it
    has these digits too.
    """
    text, size = value.cast("string"), F.abs(value)

    def plain(decimal):
        return F.regexp_replace(value.cast(decimal).cast("string"), r"(\.\d+?)0+$", "$1")

    exponent = text
    for pattern, put in ((r"\.0E", "E"), (r"E-(\d)$", "e-0$1"), ("E-", "e-"), ("E", "e+")):
        exponent = F.regexp_replace(exponent, pattern, put)
    return (
        F.when(~F.contains(text, F.lit("E")), text)
        .when((size >= 1e7) & (size < 1e16), plain("decimal(38,10)"))
        .when((size >= 1e-4) & (size < 1e-3), plain("decimal(38,22)"))
        .otherwise(exponent)
    )


def _json_value(value: Column, kind: str) -> Column:
    if kind == "string":
        # Plain texts are quoted as they are.  For others the JSON writer does the
        # escaping: a one-element array is written and its brackets are cut off.
        written = F.to_json(F.array(value))
        escaped = F.substring(written, F.lit(2), F.length(written) - 2)
        text = F.when(value.rlike(PLAIN_TEXT), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(escaped)
    elif kind == "double":
        text = _json_number(value)
    else:
        text = value.cast("string")
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("null"))


def _canonical_parts(field=F.col) -> tuple[Column, Column]:
    """Canonical JSON before and after the value of ``previous_event_hash``."""
    before, after, passed = [], [], False
    for name, kind in EVENT_FIELDS.items():
        if name == "previous_event_hash":
            passed = True
            continue
        piece = F.concat(F.lit(f'"{name}":'), _json_value(field(name), kind))
        (after if passed else before).append(piece)
    head = F.concat(F.lit("{"), F.concat_ws(",", *before), F.lit(',"previous_event_hash":"'))
    tail = F.concat(F.lit('",'), F.concat_ws(",", *after), F.lit("}"))
    return head, tail


def event_hash() -> Column:
    """sha256 of the event's canonical JSON (sorted keys, no blanks), previous hash included."""
    head, tail = _canonical_parts()
    return F.sha2(F.concat(head, F.col("previous_event_hash"), tail), 256)


def anchor(tenant: Column, segment: Column) -> Column:
    """Start of a segment: the genesis hash for the first, else a hash of its place."""
    return F.when(segment == 0, F.lit(GENESIS)).otherwise(
        F.sha2(F.concat_ws(":", F.lit("segment"), tenant, segment.cast("string")), 256)
    )


def _segment(size: int) -> Column:
    return F.expr(f"(sequence_num - 1) div {size}")


def build_chain(events: DataFrame, segment_size: int = SEGMENT) -> DataFrame:
    """Fill previous_event_hash and event_hash; sequence_num runs 1, 2, ... per tenant.

    Whole events are gathered per segment and folded there, so they are shuffled
    once and joined with nothing.  A segment holds at most ``segment_size`` events
    because sequence numbers are unique within a tenant; a repeated number ends the job
    before its segment is gathered.
    """
    bare = events.drop("previous_event_hash", "event_hash").withColumn(
        "sequence_num", F.col("sequence_num").cast("bigint")
    )
    others = [c for c in bare.columns if c != "sequence_num"]
    event = F.when(F.count(F.lit(1)) == 1, F.first(F.struct("sequence_num", *others))).otherwise(
        F.raise_error(F.concat_ws(" ", F.lit("repeated sequence number"), F.col("sequence_num").cast("string"), F.lit("of"), "tenant_id"))
    )
    # one exchange serves both aggregates
    segments = (
        bare.withColumn("__segment", _segment(segment_size))
        .repartition("tenant_id", "__segment")
        .groupBy("tenant_id", "__segment", "sequence_num")
        .agg(event.alias("event"))
        .groupBy("tenant_id", "__segment")
        .agg(F.array_sort(F.collect_list("event")).alias("events"))
        .withColumn("start", anchor(F.col("tenant_id"), F.col("__segment")))
    )

    def parts(event):
        head, tail = _canonical_parts(lambda name: event[name])
        return F.struct(head.alias("head"), tail.alias("tail"))

    def merge(hashes, item):
        last = F.element_at(hashes, -1)
        return F.array_append(hashes, F.sha2(F.concat(item["head"], last, item["tail"]), 256))

    # start, hash of the first event, hash of the second event, ...
    chained = segments.withColumn("parts", F.transform("events", parts)).withColumn(
        "hashes", F.aggregate("parts", F.array("start"), merge)
    )
    linked = F.transform(
        "events",
        lambda event, i: F.struct(
            event.alias("event"),
            F.get("hashes", i).alias("previous_event_hash"),
            F.get("hashes", i + 1).alias("event_hash"),
        ),
    )
    rows = chained.select(F.inline(linked))
    return rows.select(*[F.col(f"event.{c}").alias(c) for c in bare.columns], "previous_event_hash", "event_hash")


def segment_tails(chain: DataFrame, segment_size: int = SEGMENT) -> DataFrame:
    """Last hash and event count of every segment."""
    return chain.groupBy("tenant_id", _segment(segment_size).alias("segment")).agg(
        F.max("sequence_num").alias("sequence_end"),
        F.max_by("event_hash", "sequence_num").alias("tail_hash"),
        F.count(F.lit(1)).alias("events"),
    )


def _levels(tails: DataFrame, segment_size: int) -> int:
    """How often ``segment_size`` tails have to be folded into one until each tenant has one left."""
    last = tails.agg(F.max("segment")).first()[0] or 0
    levels = 1
    while last >= segment_size:
        last, levels = last // segment_size, levels + 1
    return levels


def _level_start(level: int, place: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit("level"), F.lit(str(level)), "tenant_id", place.cast("string")), 256)


def _folded(start: Column, hashes: Column) -> Column:
    return F.aggregate(hashes, start, lambda acc, h: F.sha2(F.concat(acc, h), 256))


def state_at(log: DataFrame, places: DataFrame, segment_size: int = SEGMENT) -> DataFrame:
    """What ``log`` holds up to each distinct place (tenant_id, sequence_end) of ``places``.

    Columns: tenant_id, sequence_end, events (rows up to it), held and held_rows (hash and
    number of the events at it), root_hash (that of ``link_segments`` over the log up to it; NULL if nothing is there).

    The tails of the segments are the leaves of an append-only tree whose nodes fold up to
    ``segment_size`` hashes of the level below; each level is built once and stored.  A node that ends
    before a place is the same for every later place, so a place takes from each level one row, the
    list that it stands in, and folds the part before it together with its own unfinished node.
    Only events of the segment a place stands in are read again.  For S segments and C places
    that is S + C * (segment_size + levels) rows, with levels the logarithm of S.
    """
    places = stored(places.select("tenant_id", "sequence_end").distinct().withColumn("place", _at(segment_size)), "places")
    tails = stored(segment_tails(log, segment_size), "tails")
    at_place = F.col("sequence_num") == F.col("sequence_end")
    own = (
        log.withColumn("place", _segment(segment_size))
        .join(places, ["tenant_id", "place"])
        .where("sequence_num <= sequence_end")
        .groupBy("tenant_id", "sequence_end")
        .agg(
            F.max_by("event_hash", "sequence_num").alias("hash"),
            F.count(F.lit(1)).alias("events"),
            F.min(F.when(at_place, F.col("event_hash"))).alias("held"),
            F.count_if(at_place).alias("held_rows"),
        )
    )
    zero = F.lit(0).cast("bigint")
    current = places.join(own, ["tenant_id", "sequence_end"], "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("events", "held_rows")}
    )
    nodes = tails.select("tenant_id", F.col("segment").alias("place"), F.col("tail_hash").alias("hash"), "events")
    reached = tails.select("segment").unionByName(places.select(F.col("place").alias("segment")))
    for level in range(_levels(reached, segment_size)):
        up = F.expr(f"place div {segment_size}")
        lists = nodes.groupBy("tenant_id", up.alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("place", "hash", "events"))).alias("items")
        )
        lists = stored(lists, f"level-{level}")
        before = F.filter("items", lambda x: x["place"] < F.col("place"))
        current = (
            current.withColumn("up", up)
            .join(lists, ["tenant_id", "up"], "left")
            .withColumn("before", F.coalesce(before, F.expr("CAST(array() AS array<struct<place: bigint, hash: string, events: bigint>>)")))
        )
        hashes = F.array_compact(F.concat(F.transform("before", lambda x: x["hash"]), F.array("hash")))
        chained = F.when(F.size(hashes) > 0, _folded(_level_start(level, F.col("up")), hashes))
        if level:  # a tenant that is down to its one hash keeps it
            chained = F.when(F.col("place") > 0, chained).otherwise(F.col("hash"))
        earlier = F.aggregate("before", zero, lambda n, x: n + x["events"])
        current = current.select(
            "tenant_id", "sequence_end", F.col("up").alias("place"), chained.alias("hash"), (F.col("events") + earlier).alias("events"), "held", "held_rows"
        )
        nodes = lists.select(
            "tenant_id",
            F.col("up").alias("place"),
            _folded(_level_start(level, F.col("up")), F.transform("items", lambda x: x["hash"])).alias("hash"),
            F.aggregate("items", zero, lambda n, x: n + x["events"]).alias("events"),
        )
    return current.select("tenant_id", "sequence_end", "events", "held", "held_rows", F.col("hash").alias("root_hash"))


def link_segments(tails: DataFrame, segment_size: int = SEGMENT, by: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Root hash per tenant (or per ``by``, of which tenant_id is one) over all its segments.

    Each level chains up to ``segment_size`` tails into one, until one is left; no fold
    grows with the tenant.  A tenant that is down to its one hash keeps it.
    """
    tails = stored(tails, "tails")
    ends = tails.groupBy(*by).agg(F.max("segment").alias("last"))
    current = tails.select(*by, F.col("segment").alias("place"), F.col("tail_hash").alias("hash")).join(ends, list(by))
    for level in range(_levels(tails, segment_size)):
        grouped = current.groupBy(*by, "last", F.expr(f"place div {segment_size}").alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("items")
        )
        chained = _folded(_level_start(level, F.col("up")), F.transform("items", lambda item: item["hash"]))
        if level:
            chained = F.when(F.col("last") > 0, chained).otherwise(F.get("items", F.lit(0))["hash"])
        current = grouped.select(*by, F.expr(f"last div {segment_size}").alias("last"), F.col("up").alias("place"), chained.alias("hash"))
    return current.groupBy(*by).agg(F.max_by("hash", "place").alias("root_hash"), F.count(F.lit(1)).alias("roots"))


HEX = r"^[0-9a-f]{64}$"
WORDS = 5


def _words(digest: Column) -> list[Column]:
    """A hex digest as numbers of 15 digits: fixed-width values keep the aggregate hash-based."""
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("bigint") for i in range(WORDS)]


def check_chain(log: DataFrame, segment_size: int | None = None) -> DataFrame:
    """Every position of the log with its ``problem``, NULL where it is sound.

    Each event is reported once as itself and once as the predecessor of the next
    position, by the task that reads it; one hash aggregate with map-side combine brings the two together.
    Only number 1 may stand without a predecessor; where a segment starts, the
    predecessor has to be there but the link is the anchor.
    ``segment_size=None`` verifies an unsegmented chain.
    """
    number = F.col("sequence_num").cast("bigint")
    start = number == 1
    expected = F.when(start, F.lit(GENESIS))
    if segment_size is not None:
        opens = F.expr(f"(sequence_num - 1) % {segment_size}") == 0
        expected = expected.when(opens, anchor(F.col("tenant_id"), _segment(segment_size)))
        start = start | opens
    zero = F.lit(0).cast("bigint")
    previous = F.coalesce("previous_event_hash", F.lit(""))
    own = F.struct(
        number.alias("sequence_num"),
        F.lit(1).alias("rows"),
        F.lit(0).alias("before"),
        start.alias("start"),
        (~event_hash().eqNullSafe(F.col("event_hash"))).alias("bad_hash"),
        (~previous.rlike(HEX) | (start & (previous != F.coalesce(expected, previous)))).alias("bad_link"),
        *[F.coalesce(w, zero).alias(f"w{i}") for i, w in enumerate(_words(previous))],
    )
    ahead = F.struct(
        (number + 1).alias("sequence_num"),
        F.lit(0).alias("rows"),
        F.lit(1).alias("before"),
        F.lit(False).alias("start"),
        F.lit(False).alias("bad_hash"),
        F.lit(False).alias("bad_link"),
        *[F.coalesce(w, zero).alias(f"w{i}") for i, w in enumerate(_words(F.col("event_hash")))],
    )
    met = (
        log.select("tenant_id", F.inline(F.array(own, ahead)))
        .groupBy("tenant_id", "sequence_num")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("before").alias("before"),
            *[F.bool_or(flag).alias(flag) for flag in ("start", "bad_hash", "bad_link")],
            *[side(f"w{i}").alias(f"{name}{i}") for name, side in (("least", F.min), ("most", F.max)) for i in range(WORDS)],
        )
        .where(F.col("rows") > 0)
    )
    # the link and the hash of each row of the predecessor, which may be repeated, are all one
    linked = F.lit(True)
    for i in range(WORDS):
        linked = linked & (F.col(f"least{i}") == F.col(f"most{i}"))
    problem = (
        F.when(F.col("rows") > 1, "duplicate_sequence")
        .when(F.col("bad_hash"), "hash_mismatch")
        .when((F.col("sequence_num") != 1) & (F.col("before") == 0), "missing_predecessor")
        .when(F.col("bad_link") | (~F.col("start") & ~linked), "broken_link")
    )
    return met.select("tenant_id", "sequence_num", "rows", problem.alias("problem"))


def verify_chain(log: DataFrame, segment_size: int | None = None) -> DataFrame:
    """The broken positions only; empty for an intact log."""
    return check_chain(log, segment_size).where(F.col("problem").isNotNull())


def checkpoint(log: DataFrame, timestamp: float, key_id: str, segment_size: int = SEGMENT) -> DataFrame:
    """End of each tenant's log: sequence number, hash, event count and root over all segments."""
    tails = stored(segment_tails(log, segment_size), "tails")
    ends = tails.groupBy("tenant_id").agg(
        F.max("sequence_end").alias("sequence_end"),
        F.max_by("tail_hash", "sequence_end").alias("last_event_hash"),
        F.sum("events").alias("total_events"),
    )
    return ends.join(link_segments(tails, segment_size).drop("roots"), "tenant_id").select(
        F.concat_ws("-", F.lit("cp"), "tenant_id", "sequence_end").alias("checkpoint_id"),
        "tenant_id",
        "sequence_end",
        "last_event_hash",
        "total_events",
        "root_hash",
        F.lit(float(timestamp)).alias("checkpoint_timestamp"),
        F.lit(key_id).alias("key_id"),
    )


def checkpoints_at(log: DataFrame, places: DataFrame, timestamp: float, key_id: str, segment_size: int = SEGMENT) -> DataFrame:
    """Checkpoints for many places (tenant_id, sequence_end) of one log at once; a place whose event is not there exactly once gets none."""
    return state_at(log, places, segment_size).where("held_rows = 1").select(
        F.concat_ws("-", F.lit("cp"), "tenant_id", "sequence_end").alias("checkpoint_id"),
        "tenant_id",
        "sequence_end",
        F.col("held").alias("last_event_hash"),
        F.col("events").alias("total_events"),
        "root_hash",
        F.lit(float(timestamp)).alias("checkpoint_timestamp"),
        F.lit(key_id).alias("key_id"),
    )


def _payload() -> Column:
    return F.concat_ws(
        ":",
        "checkpoint_id",
        F.col("sequence_end").cast("string"),
        "last_event_hash",
        F.col("total_events").cast("string"),
        "root_hash",
        _json_number(F.col("checkpoint_timestamp")),
        "key_id",
    )


def _hmac_udf(key: str):
    """HMAC-SHA256; the key travels in the function, never in the query plan."""

    @F.pandas_udf("string")
    def digest(payload: pd.Series) -> pd.Series:
        return payload.map(lambda p: hmac.new(key.encode(), p.encode(), hashlib.sha256).hexdigest())

    return digest


def sign_checkpoints(checkpoints: DataFrame, key: str) -> DataFrame:
    return checkpoints.withColumn("signature", _hmac_udf(key)(_payload()))


def verify_checkpoints(log: DataFrame, checkpoints: DataFrame, key: str | None = None, segment_size: int = SEGMENT) -> DataFrame:
    """Adds signature_ok (NULL without a key), anchored, complete, root_ok, chain_ok and valid to each checkpoint.

    All is judged up to the checkpoint's place: its event is there once with its hash
    (anchored), the log holds as many events as it signs (complete), the segments
    give its root (root_ok), and no position is broken (chain_ok).  The work grows with
    the log and the checkpoints, not with their product (``state_at``).
    """
    checkpoints = stored(checkpoints, "checkpoints")
    state = state_at(log, checkpoints, segment_size).select(
        "tenant_id",
        "sequence_end",
        F.col("events").alias("__events"),
        F.col("held").alias("__held"),
        F.col("held_rows").alias("__rows"),
        F.col("root_hash").alias("__root"),
    )
    # a tenant's first broken position decides for all of its checkpoints
    first = verify_chain(log, segment_size).groupBy("tenant_id").agg(F.min("sequence_num").alias("__first"))
    rows = checkpoints.join(state, ["tenant_id", "sequence_end"], "left").join(first, "tenant_id", "left")
    signature_ok = F.lit(None).cast("boolean")
    if key is not None:
        signature_ok = F.col("signature") == _hmac_udf(key)(_payload())
    checks = {
        "anchored": (F.col("__held") == F.col("last_event_hash")) & (F.col("__rows") == 1),
        "complete": F.col("__events") == F.col("total_events"),
        "root_ok": F.col("__root") == F.col("root_hash"),
    }
    rows = rows.withColumn("signature_ok", signature_ok).withColumns({c: F.coalesce(v, F.lit(False)) for c, v in checks.items()})
    valid = F.coalesce("signature_ok", F.lit(True)) & F.col("anchored") & F.col("complete") & F.col("root_ok") & F.col("chain_ok")
    intact = F.coalesce(F.col("__first") > F.col("sequence_end"), F.lit(True))
    added = ["signature_ok", *checks, "chain_ok", "valid"]
    return rows.withColumn("chain_ok", intact).withColumn("valid", valid).select(*checkpoints.columns, *added)


def _at(size: int) -> Column:
    """The segment of a checkpoint's end."""
    return F.expr(f"(sequence_end - 1) div {size}")
