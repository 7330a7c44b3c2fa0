"""Registered ledger jobs.

The replay oracle is a DuckDB recursive CTE stepping through each
location's commands by row number; Spark runs the fast path + sorted fold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stockflow.operators import ledger as L
from stockflow.plans.registry import register
from stockflow.sources.domain import domain

# Ledger rows read back as commands, numbered per location in (ts, id) order.
CMDS_SQL = """
, cmds AS (
  SELECT inventory_id, transaction_id AS command_id, transaction_date AS ts,
         CASE transaction_type WHEN 'Receipt' THEN 'receive' WHEN 'Reservation' THEN 'reserve'
              WHEN 'Issue' THEN 'issue' WHEN 'Release' THEN 'release' ELSE 'adjust_by' END AS command,
         cast(CASE WHEN transaction_type IN ('Issue', 'Release') THEN -quantity ELSE quantity END AS int) AS quantity,
         work_order_id,
         row_number() OVER (PARTITION BY inventory_id ORDER BY transaction_date, transaction_id) AS rn
  FROM inventory_transactions)
"""

REPLAY_SQL = CMDS_SQL + """
, fold AS (
  SELECT inventory_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS oh, CAST(0 AS BIGINT) AS rs,
         CAST(0 AS BIGINT) AS ohb, CAST(0 AS BIGINT) AS rsb, CAST(NULL AS VARCHAR) AS reason
  FROM (SELECT DISTINCT inventory_id FROM cmds) k
  UNION ALL
  SELECT inventory_id, rn,
         CASE WHEN reason IS NOT NULL THEN ohb
              WHEN command = 'receive' THEN ohb + quantity WHEN command = 'issue' THEN ohb - quantity
              WHEN command = 'adjust_by' THEN ohb + quantity ELSE ohb END AS oh,
         CASE WHEN reason IS NOT NULL THEN rsb
              WHEN command = 'reserve' THEN rsb + quantity WHEN command IN ('release', 'issue') THEN rsb - quantity
              ELSE rsb END AS rs,
         ohb, rsb, reason
  FROM (
    SELECT c.inventory_id, c.rn, c.command, c.quantity, f.oh AS ohb, f.rs AS rsb,
           CASE WHEN c.quantity IS NULL THEN 'invalid_quantity'
                WHEN c.command = 'adjust_by' AND f.oh + c.quantity < 0 THEN 'negative_target'
                WHEN c.command = 'adjust_by' AND f.oh + c.quantity < f.rs THEN 'target_below_reserved'
                WHEN c.command = 'adjust_by' THEN NULL
                WHEN c.quantity <= 0 THEN 'invalid_quantity'
                WHEN c.command = 'reserve' AND c.quantity > f.oh - f.rs THEN 'insufficient_available'
                WHEN c.command IN ('release', 'issue') AND c.quantity > f.rs THEN 'insufficient_reserved'
                WHEN c.command = 'issue' AND c.quantity > f.oh THEN 'insufficient_on_hand'
           END AS reason
    FROM fold f JOIN cmds c ON c.inventory_id = f.inventory_id AND c.rn = f.rn + 1) s),
replayed AS (
  SELECT c.inventory_id, c.command_id, c.ts, c.command, c.quantity, c.work_order_id,
         f.reason IS NULL AS accepted, f.reason,
         f.ohb AS on_hand_before, f.rsb AS reserved_before, f.oh AS on_hand_after, f.rs AS reserved_after
  FROM cmds c JOIN fold f ON f.inventory_id = c.inventory_id AND f.rn = c.rn)
"""


def _replayed(spark, sf_dir, fast_path=True):
    d = domain(spark, sf_dir)
    return L.replay(L.ledger_commands(d.inventory_transactions), None, fast_path=fast_path)


@register("stock_running_balance", """
SELECT *,
       cast(sum(CASE WHEN transaction_type IN ('Receipt', 'Issue', 'Adjustment') THEN quantity ELSE 0 END)
            OVER w AS bigint) AS running_on_hand,
       cast(sum(CASE WHEN transaction_type IN ('Reservation', 'Release', 'Issue') THEN quantity ELSE 0 END)
            OVER w AS bigint) AS running_reserved,
       cast(sum(CASE WHEN transaction_type IN ('Receipt', 'Issue', 'Adjustment') THEN quantity ELSE 0 END) OVER w
            - sum(CASE WHEN transaction_type IN ('Reservation', 'Release', 'Issue') THEN quantity ELSE 0 END) OVER w
            AS bigint) AS running_available
FROM inventory_transactions
WINDOW w AS (PARTITION BY inventory_id ORDER BY transaction_date, transaction_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def q_stock_running_balance(spark, sf_dir):
    return L.running_balance(domain(spark, sf_dir).inventory_transactions)


@register("ledger_replay", REPLAY_SQL + "SELECT * FROM replayed", recursive=True)
def q_ledger_replay(spark, sf_dir):
    return _replayed(spark, sf_dir)


@register("ledger_closing", REPLAY_SQL + """
SELECT inventory_id,
       arg_max(on_hand_after, (ts, command_id)) AS closing_on_hand,
       arg_max(reserved_after, (ts, command_id)) AS closing_reserved,
       count(*) AS command_count,
       count(*) FILTER (WHERE accepted) AS accepted_count,
       count(*) FILTER (WHERE NOT accepted) AS rejected_count
FROM replayed GROUP BY inventory_id
""", recursive=True)
def q_ledger_closing(spark, sf_dir):
    d = domain(spark, sf_dir)
    return L.replay_closing(L.ledger_commands(d.inventory_transactions))


_ENV_NULLS = {
    "int": ["quantity", "available", "min_level", "reorder_qty"],
    "bigint": ["inventory_id", "part_id", "work_order_id", "on_hand", "old_qty", "new_qty", "difference"],
    "decimal(18,2)": ["old_cost", "new_cost", "old_price", "new_price"],
    "varchar": ["event_id", "event_type", "warehouse", "reason", "reference", "part_number"],
    "timestamp": ["occurred_on"],
}


def envelope_sql(values: dict[str, str]) -> str:
    """SELECT list for the event envelope: given expressions, typed NULLs elsewhere."""
    types = {c: t for t, cols in _ENV_NULLS.items() for c in cols}
    return ", ".join(f"CAST({values.get(c, 'NULL')} AS {types[c]}) AS {c}" for c in L.EVENT_COLUMNS)


ACC_CTE = """
, acc AS (
  SELECT r.*, i.part_id, i.warehouse,
         CASE r.command WHEN 'reserve' THEN 'InventoryReserved' WHEN 'issue' THEN 'InventoryIssued'
              WHEN 'receive' THEN 'InventoryReceived' ELSE 'InventoryAdjusted' END AS et
  FROM replayed r LEFT JOIN inventory i ON i.inventory_id = r.inventory_id
  WHERE r.accepted AND r.command <> 'release')
"""

ACC_SELECT = "SELECT " + envelope_sql({
    "event_id": "concat(command_id, '/', et)", "event_type": "et", "occurred_on": "ts",
    "inventory_id": "inventory_id", "part_id": "part_id",
    "work_order_id": "CASE WHEN command IN ('reserve', 'issue') THEN work_order_id END",
    "warehouse": "warehouse",
    "quantity": "CASE WHEN command NOT IN ('adjust', 'adjust_by') THEN quantity END",
    "available": "CASE WHEN command = 'reserve' THEN on_hand_after - reserved_after END",
    "on_hand": "CASE WHEN command IN ('issue', 'receive') THEN on_hand_after END",
    "old_qty": "CASE WHEN command IN ('adjust', 'adjust_by') THEN on_hand_before END",
    "new_qty": "CASE WHEN command IN ('adjust', 'adjust_by') THEN on_hand_after END",
    "difference": "CASE WHEN command IN ('adjust', 'adjust_by') THEN on_hand_after - on_hand_before END",
    "reference": "CASE WHEN command = 'receive' THEN '' END",
}) + " FROM acc"

INVENTORY_EVENTS_SQL = REPLAY_SQL + ACC_CTE + ACC_SELECT


@register("inventory_events", INVENTORY_EVENTS_SQL, recursive=True)
def q_inventory_events(spark, sf_dir):
    d = domain(spark, sf_dir)
    return L.inventory_events(_replayed(spark, sf_dir), d.inventory)


LOW_CTE = """
, low AS (
  SELECT r.*, i.part_id, i.warehouse, i.minimum_stock_level, i.reorder_quantity,
         r.on_hand_after - r.reserved_after AS avail
  FROM replayed r JOIN inventory i ON i.inventory_id = r.inventory_id
  WHERE r.accepted AND r.command IN ('issue', 'adjust', 'adjust_by')
    AND r.on_hand_after - r.reserved_after <= i.minimum_stock_level)
"""

LOW_STOCK_EVENTS_SQL = REPLAY_SQL + LOW_CTE

LOW_STOCK_EVENTS_SELECT = "SELECT " + envelope_sql({
    "event_id": "concat(command_id, '/InventoryLowStockDetected')", "event_type": "'InventoryLowStockDetected'",
    "occurred_on": "ts", "inventory_id": "inventory_id", "part_id": "part_id", "warehouse": "warehouse",
    "available": "avail", "min_level": "minimum_stock_level", "reorder_qty": "reorder_quantity",
}) + " FROM low"


@register("low_stock_events", LOW_STOCK_EVENTS_SQL + LOW_STOCK_EVENTS_SELECT, recursive=True)
def q_low_stock_events(spark, sf_dir):
    d = domain(spark, sf_dir)
    return L.low_stock_events(_replayed(spark, sf_dir), d.inventory)


ALLOCATE_SQL = """
, req AS (SELECT concat(cast(work_order_id AS varchar), '-', cast(line_no AS varchar)) AS request_id,
                 part_id, quantity, row_number() OVER () AS rid FROM reservation_requests),
loc AS (SELECT part_id, inventory_id, warehouse, quantity_on_hand - quantity_reserved AS raw,
               greatest(quantity_on_hand - quantity_reserved, 0) AS available FROM inventory WHERE is_active),
j AS (SELECT r.rid, r.request_id, r.part_id, r.quantity, l.inventory_id, l.warehouse, l.available, l.raw,
             coalesce(sum(l.available) OVER (PARTITION BY r.rid ORDER BY l.warehouse, l.inventory_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(l.raw) OVER (PARTITION BY r.rid) AS total_available
      FROM req r JOIN loc l ON l.part_id = r.part_id)
SELECT request_id, part_id, quantity, inventory_id, warehouse, available, cast(total_available AS bigint) AS total_available,
       total_available >= quantity AS fulfilled,
       cast(CASE WHEN total_available >= quantity THEN greatest(0, least(available, quantity - before)) ELSE 0 END
            AS bigint) AS taken
FROM j
"""


@register("reservation_allocation", ALLOCATE_SQL)
def q_reservation_allocation(spark, sf_dir):
    d = domain(spark, sf_dir)
    req = d.reservation_requests.select(
        F.concat(F.col("work_order_id").cast("string"), F.lit("-"), F.col("line_no").cast("string"))
        .alias("request_id"), "part_id", "quantity")
    return L.allocate(req, d.inventory)


QUEUE_SQL = """
, tot AS (SELECT p.part_id, coalesce(sum(i.quantity_on_hand - i.quantity_reserved), 0) AS total
          FROM parts p LEFT JOIN inventory i ON i.part_id = p.part_id AND i.is_active GROUP BY p.part_id),
q AS (SELECT r.*, t.total, t.total IS NOT NULL AND coalesce(r.quantity >= 1, false) AS valid
      FROM reservation_requests r LEFT JOIN tot t ON t.part_id = r.part_id),
need AS (SELECT work_order_id, part_id, min(created_at) AS created_at, sum(quantity) AS units, max(total) AS total, bool_and(valid) AS valid
         FROM q GROUP BY work_order_id, part_id),
ok AS (SELECT work_order_id FROM need GROUP BY work_order_id HAVING bool_and(valid)),
walk AS (
  SELECT 0 AS it, work_order_id, part_id, created_at, units, total, 0 AS state FROM need JOIN ok USING (work_order_id)
  UNION ALL
  SELECT it + 1, work_order_id, part_id, created_at, units, total,
         CASE WHEN state <> 0 THEN state WHEN bool_and(most + units <= total) OVER o THEN 1 WHEN bool_or(least + units > total) OVER o THEN -1 ELSE 0 END
  FROM (SELECT *, coalesce(sum(CASE WHEN state >= 0 THEN units ELSE 0 END) OVER p, 0) AS most, coalesce(sum(CASE WHEN state = 1 THEN units ELSE 0 END) OVER p, 0) AS least,
               max(CASE WHEN state = 0 THEN 1 ELSE 0 END) OVER () AS open
        FROM walk WINDOW p AS (PARTITION BY part_id ORDER BY created_at, work_order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x
  WHERE open = 1 WINDOW o AS (PARTITION BY work_order_id)),
won AS (SELECT DISTINCT work_order_id FROM walk WHERE state = 1),
c AS (SELECT q.*, w.work_order_id IS NOT NULL AS order_committed, CASE WHEN q.valid THEN q.quantity ELSE 0 END AS units FROM q LEFT JOIN won w ON w.work_order_id = q.work_order_id),
d AS (SELECT *, coalesce(sum(CASE WHEN order_committed THEN units ELSE 0 END) OVER (PARTITION BY part_id ORDER BY created_at, work_order_id, line_no, quantity
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             + CASE WHEN order_committed THEN 0 ELSE coalesce(sum(units) OVER (PARTITION BY work_order_id, part_id ORDER BY created_at, line_no, quantity
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS before FROM c),
flag AS (SELECT work_order_id, line_no, part_id, quantity, created_at, reason IS NULL AS line_accepted, reason, CAST(before AS BIGINT) AS demand_before,
                CAST(before + CASE WHEN order_committed THEN units ELSE 0 END AS BIGINT) AS demand_after, order_committed
         FROM (SELECT *, CASE WHEN total IS NULL THEN 'part_not_found' WHEN coalesce(quantity < 1, true) THEN 'invalid_quantity'
                              WHEN before + quantity > total THEN 'insufficient_inventory' END AS reason FROM d) x),
sup AS (SELECT part_id, inventory_id, warehouse, quantity_on_hand - quantity_reserved AS av,
               sum(quantity_on_hand - quantity_reserved) OVER (PARTITION BY part_id ORDER BY warehouse, inventory_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shi
        FROM inventory WHERE is_active AND quantity_on_hand - quantity_reserved > 0)
SELECT f.*, s.inventory_id, s.warehouse, cast(least(f.demand_after, s.shi) - greatest(f.demand_before, s.shi - s.av) AS bigint) AS taken
FROM flag f JOIN sup s ON s.part_id = f.part_id AND f.demand_before < s.shi AND s.shi - s.av < f.demand_after
WHERE f.order_committed
UNION ALL
SELECT f.*, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM flag f WHERE NOT f.order_committed
"""


@register("reservation_queue", QUEUE_SQL, recursive=True)
def q_reservation_queue(spark, sf_dir):
    d = domain(spark, sf_dir)
    return L.allocate_queue(d.reservation_requests, d.inventory, d.parts)


@register("reorder_suggestions", LOW_STOCK_EVENTS_SQL + """
SELECT part_id, warehouse, inventory_id, reorder_quantity AS quantity_to_order,
       CASE WHEN avail = 0 THEN 'Critical' ELSE 'Normal' END AS priority,
       ts AS created_at, concat(command_id, '/InventoryLowStockDetected') AS source_event_id,
       row_number() OVER (PARTITION BY warehouse ORDER BY avail = 0 DESC, ts, concat(command_id, '/InventoryLowStockDetected')) AS urgency_rank
FROM low
""", recursive=True)
def q_reorder_suggestions(spark, sf_dir):
    d = domain(spark, sf_dir)
    return L.reorder_suggestions(L.low_stock_events(_replayed(spark, sf_dir), d.inventory))


@register("transactions_view", """
SELECT transaction_id, inventory_id, transaction_type, quantity, work_order_id,
       CASE transaction_type
         WHEN 'Reservation' THEN concat('Reserved ', cast(abs(quantity) AS varchar), ' parts for work order')
         WHEN 'Release' THEN concat('Released ', cast(abs(quantity) AS varchar), ' parts reservation')
         WHEN 'Issue' THEN concat('Issued ', cast(abs(quantity) AS varchar), ' parts to work order')
         WHEN 'Receipt' THEN concat('Received ', cast(abs(quantity) AS varchar), ' parts')
       END AS notes, transaction_date
FROM inventory_transactions
""")
def q_transactions_view(spark, sf_dir):
    return L.tx_view(domain(spark, sf_dir).inventory_transactions)


LOCATION_CMDS_SQL = """
, lcmd AS (
  SELECT user_id * 10 + event_id % 5 AS inventory_id, cast(event_id AS varchar) AS command_id, ts,
         CASE event_type WHEN 'view' THEN 'set_levels' WHEN 'click' THEN 'move_bin' WHEN 'error' THEN 'deactivate'
              WHEN 'signup' THEN 'receive' ELSE 'adjust' END AS command,
         CASE WHEN event_type IN ('signup', 'purchase') THEN cast(floor(value) AS int) END AS quantity,
         CASE WHEN event_type = 'view' THEN cast(event_id % 30 AS int) END AS new_min,
         CASE WHEN event_type = 'view' THEN cast(event_id % 60 AS int) END AS new_max,
         CASE WHEN event_type = 'view' THEN cast(event_id % 60 - event_id % 30 AS int) END AS new_reorder,
         CASE WHEN event_type = 'click' THEN concat('B-', lpad(cast(event_id % 40 AS varchar), 2, '0'), '-',
                                                    cast(event_id % 7 AS varchar)) END AS new_bin
  FROM events),
lq AS (SELECT c.*, row_number() OVER (PARTITION BY c.inventory_id ORDER BY c.ts, c.command_id) AS rn FROM lcmd c),
lwalk AS (
  SELECT k.inventory_id, CAST(0 AS BIGINT) AS rn, i.inventory_id IS NOT NULL AS ex,
         CAST(i.quantity_on_hand AS BIGINT) AS oh, CAST(i.quantity_reserved AS BIGINT) AS rs,
         i.minimum_stock_level AS mn, i.maximum_stock_level AS mx, i.reorder_quantity AS ro,
         i.bin_location AS bin, i.is_active AS act, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS note
  FROM (SELECT DISTINCT inventory_id FROM lq) k LEFT JOIN inventory i ON i.inventory_id = k.inventory_id
  UNION ALL
  SELECT inventory_id, rn, ex,
         CASE WHEN reason IS NULL AND command = 'receive' THEN oh + quantity
              WHEN reason IS NULL AND command = 'adjust' THEN quantity ELSE oh END,
         rs,
         CASE WHEN reason IS NULL AND command = 'set_levels' THEN new_min ELSE mn END,
         CASE WHEN reason IS NULL AND command = 'set_levels' THEN new_max ELSE mx END,
         CASE WHEN reason IS NULL AND command = 'set_levels' THEN new_reorder ELSE ro END,
         CASE WHEN reason IS NULL AND command = 'move_bin' THEN new_bin ELSE bin END,
         CASE WHEN reason IS NULL AND command = 'deactivate' THEN false ELSE act END,
         reason,
         CASE WHEN reason IS NULL AND command = 'move_bin' THEN concat('Moved from ', bin, ' to ', new_bin) END
  FROM (SELECT q.inventory_id, q.rn, q.command, q.quantity, q.new_min, q.new_max, q.new_reorder, q.new_bin,
               w.ex, w.oh, w.rs, w.mn, w.mx, w.ro, w.bin, w.act,
               CASE WHEN NOT w.ex THEN 'location_not_found'
                    WHEN q.command IN ('receive', 'adjust') AND q.quantity IS NULL THEN 'invalid_quantity'
                    WHEN q.command = 'adjust' AND q.quantity < 0 THEN 'negative_target'
                    WHEN q.command = 'adjust' AND q.quantity < w.rs THEN 'target_below_reserved'
                    WHEN q.command = 'receive' AND q.quantity <= 0 THEN 'invalid_quantity'
                    WHEN q.command = 'set_levels' AND (q.new_min IS NULL OR q.new_max IS NULL OR q.new_reorder IS NULL)
                      THEN 'levels_required'
                    WHEN q.command = 'set_levels' AND q.new_min < 0 THEN 'negative_minimum'
                    WHEN q.command = 'set_levels' AND q.new_max < q.new_min THEN 'maximum_below_minimum'
                    WHEN q.command = 'set_levels' AND q.new_reorder < 0 THEN 'negative_reorder'
                    WHEN q.command = 'move_bin' AND (q.new_bin IS NULL OR trim(q.new_bin) = '') THEN 'bin_required'
                    WHEN q.command = 'deactivate' AND w.oh > 0 THEN 'stock_on_hand'
                    WHEN q.command = 'deactivate' AND w.rs > 0 THEN 'stock_reserved'
               END AS reason
        FROM lwalk w JOIN lq q ON q.inventory_id = w.inventory_id AND q.rn = w.rn + 1) s)
"""


def location_commands(d):
    """Location commands derived from the event table (one per event, location = part x region)."""
    e = d.raw("events")
    et, eid = F.col("event_type"), F.col("event_id")
    qty = F.when(et.isin("signup", "purchase"), F.floor("value").cast("int"))
    return e.select(
        (F.col("user_id") * 10 + eid % 5).alias("inventory_id"), eid.cast("string").alias("command_id"), "ts",
        F.when(et == "view", "set_levels").when(et == "click", "move_bin").when(et == "error", "deactivate")
         .when(et == "signup", "receive").otherwise("adjust").alias("command"),
        qty.alias("quantity"),
        F.when(et == "view", (eid % 30).cast("int")).alias("new_min"),
        F.when(et == "view", (eid % 60).cast("int")).alias("new_max"),
        F.when(et == "view", (eid % 60 - eid % 30).cast("int")).alias("new_reorder"),
        F.when(et == "click", F.concat(F.lit("B-"), F.lpad((eid % 40).cast("string"), 2, "0"), F.lit("-"),
                                       (eid % 7).cast("string"))).alias("new_bin"))


@register("stock_level_changes", LOCATION_CMDS_SQL + """
SELECT q.inventory_id, q.command_id, q.ts, q.command, w.reason IS NULL AS accepted, w.reason,
       w.oh AS on_hand, w.rs AS reserved, w.mn AS minimum_stock_level, w.mx AS maximum_stock_level,
       w.ro AS reorder_quantity, w.bin AS bin_location, w.act AS is_active, w.note AS ledger_note
FROM lq q JOIN lwalk w ON w.inventory_id = q.inventory_id AND w.rn = q.rn
""", recursive=True)
def q_stock_level_changes(spark, sf_dir):
    d = domain(spark, sf_dir)
    return L.apply_location_commands(d.inventory, location_commands(d))
