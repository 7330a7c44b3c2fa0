"""Registered command jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockflow.functions.enums import enum_case_sql
from stockflow.operators import commands as C
from stockflow.plans.registry import register
from stockflow.sources.domain import domain

JUDGED_SQL = """
, judged AS (
  SELECT c.*,
         CASE WHEN p.part_id IS NULL THEN 'part_not_found'
              WHEN c.command = 'price' AND (c.new_cost IS NULL OR c.new_price IS NULL) THEN 'price_required'
              WHEN c.command = 'price' AND (c.new_cost < 0 OR c.new_price < 0) THEN 'negative_amount'
              WHEN c.command = 'defaults' AND (c.new_min IS NULL OR c.new_max IS NULL) THEN 'levels_required'
              WHEN c.command = 'defaults' AND c.new_min < 0 THEN 'negative_minimum'
              WHEN c.command = 'defaults' AND c.new_max < c.new_min THEN 'maximum_below_minimum'
              WHEN c.command = 'supplier' AND c.new_lead_time < 0 THEN 'negative_lead_time'
              WHEN c.command IS NULL OR c.command NOT IN ('price', 'defaults', 'supplier', 'discontinue', 'reactivate')
                THEN 'unknown_command'
         END AS reason
  FROM part_commands c LEFT JOIN parts p ON p.part_id = c.part_id)
"""


# all seven part commands; some are for parts that only a create command of the batch brings in
CATALOG_COMMANDS_SQL = """
, cc AS (
  SELECT event_id AS seq, ts, CASE WHEN event_id % 5 = 0 THEN user_id + 100000000 ELSE user_id END AS part_id,
         CASE event_type WHEN 'purchase' THEN 'price' WHEN 'error' THEN 'discontinue' WHEN 'view' THEN 'defaults'
              WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'create' ELSE 'reactivate' END
              ELSE CASE WHEN event_id % 3 = 0 THEN 'info' ELSE 'supplier' END END AS command,
         cast(value AS decimal(18,2)) AS new_cost,
         cast(cast(value AS decimal(18,2)) * cast(1.25 AS decimal(3,2)) AS decimal(18,2)) AS new_price,
         cast(event_id % 30 AS int) AS new_min, cast(event_id % 60 AS int) AS new_max, cast(event_id % 40 AS int) - 3 AS new_reorder,
         CASE WHEN event_id % 13 = 0 THEN ' ' ELSE concat('N-', cast(user_id AS varchar)) END AS new_number,
         CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('Name ', cast(event_id AS varchar)) END AS new_name,
         CASE WHEN event_id % 7 <> 0 THEN concat('About ', cast(event_id AS varchar)) END AS new_description,
         concat('Group ', cast(event_id % 9 AS varchar)) AS new_category,
         event_id % 100 AS new_supplier_id, concat('S-', cast(event_id AS varchar)) AS new_supplier_number,
         cast(event_id % 25 AS int) - 2 AS new_lead_time
  FROM events),
v AS (SELECT cc.*, p.part_id IS NOT NULL AS known,
             CASE WHEN trim(new_number) = '' THEN 'part_number_required' WHEN trim(new_name) = '' THEN 'part_name_required'
                  WHEN new_cost IS NULL OR new_price IS NULL THEN 'price_required'
                  WHEN new_cost < 0 OR new_price < 0 THEN 'negative_amount' END AS bad
      FROM cc LEFT JOIN parts p ON p.part_id = cc.part_id),
born AS (SELECT part_id, min(seq) AS born FROM v WHERE command = 'create' AND NOT known AND bad IS NULL GROUP BY part_id),
judged AS (
  SELECT v.*, CASE WHEN NOT (known OR coalesce(seq > born, false)) AND command <> 'create' THEN 'part_not_found'
                   WHEN command = 'create' THEN CASE WHEN known OR coalesce(seq > born, false) THEN 'part_exists' ELSE bad END
                   WHEN command = 'info' AND trim(new_name) = '' THEN 'part_name_required'
                   WHEN command = 'price' AND (new_cost IS NULL OR new_price IS NULL) THEN 'price_required'
                   WHEN command = 'price' AND (new_cost < 0 OR new_price < 0) THEN 'negative_amount'
                   WHEN command = 'defaults' AND new_max < new_min THEN 'maximum_below_minimum'
                   WHEN command = 'defaults' AND new_reorder < 0 THEN 'negative_reorder'
                   WHEN command = 'supplier' AND new_lead_time < 0 THEN 'negative_lead_time' END AS reason
  FROM v LEFT JOIN born ON born.part_id = v.part_id),
ok AS (SELECT * FROM judged WHERE reason IS NULL),
c1 AS (SELECT part_id, new_number FROM ok WHERE command = 'create' QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY seq DESC) = 1),
c2 AS (SELECT * FROM ok WHERE command IN ('create', 'info') QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY seq DESC) = 1),
c3 AS (SELECT * FROM ok WHERE command IN ('create', 'price') QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY seq DESC) = 1),
c4 AS (SELECT * FROM ok WHERE command = 'defaults' QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY seq DESC) = 1),
c5 AS (SELECT * FROM ok WHERE command = 'supplier' QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY seq DESC) = 1),
c6 AS (SELECT * FROM ok WHERE command IN ('discontinue', 'reactivate') QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY seq DESC) = 1),
cnt AS (SELECT part_id, count(*) FILTER (WHERE reason IS NULL) AS applied, count(*) FILTER (WHERE reason IS NOT NULL) AS rejected FROM judged GROUP BY part_id),
ids AS (SELECT part_id FROM parts UNION SELECT part_id FROM c1)
"""


@register("part_commands", CATALOG_COMMANDS_SQL + """
SELECT i.part_id, coalesce(c1.new_number, p.part_number) AS part_number,
       CASE WHEN c2.part_id IS NOT NULL THEN c2.new_name ELSE p.part_name END AS part_name,
       CASE WHEN c2.part_id IS NOT NULL THEN c2.new_description ELSE p.description END AS description,
       CASE WHEN c2.part_id IS NOT NULL THEN c2.new_category ELSE p.category END AS category,
       cast(CASE WHEN c3.part_id IS NOT NULL THEN c3.new_cost ELSE p.unit_cost END AS decimal(18,2)) AS unit_cost,
       coalesce(p.unit_cost_currency, 'USD') AS unit_cost_currency,
       cast(CASE WHEN c3.part_id IS NOT NULL THEN c3.new_price ELSE p.unit_price END AS decimal(18,2)) AS unit_price,
       coalesce(p.unit_price_currency, 'USD') AS unit_price_currency,
       CASE WHEN c5.part_id IS NOT NULL THEN c5.new_supplier_id ELSE p.supplier_id END AS supplier_id,
       coalesce(c5.new_supplier_number, '') AS supplier_part_number,
       cast(CASE WHEN c5.part_id IS NOT NULL THEN c5.new_lead_time ELSE coalesce(p.lead_time_days, 0) END AS int) AS lead_time_days,
       cast(CASE WHEN c4.part_id IS NOT NULL THEN c4.new_min ELSE coalesce(p.default_minimum_stock_level, 0) END AS int) AS default_minimum_stock_level,
       cast(CASE WHEN c4.part_id IS NOT NULL THEN c4.new_max ELSE coalesce(p.default_maximum_stock_level, 0) END AS int) AS default_maximum_stock_level,
       coalesce(c4.new_reorder, 0) AS default_reorder_quantity,
       CASE WHEN c6.part_id IS NOT NULL THEN c6.command = 'discontinue' ELSE coalesce(p.is_discontinued, false) END AS is_discontinued,
       CASE WHEN c6.part_id IS NOT NULL THEN c6.command <> 'discontinue' ELSE coalesce(p.is_active, true) END AS is_active,
       coalesce(cnt.applied, 0) AS commands_applied, coalesce(cnt.rejected, 0) AS commands_rejected
FROM ids i LEFT JOIN parts p ON p.part_id = i.part_id LEFT JOIN c1 ON c1.part_id = i.part_id LEFT JOIN c2 ON c2.part_id = i.part_id
LEFT JOIN c3 ON c3.part_id = i.part_id LEFT JOIN c4 ON c4.part_id = i.part_id LEFT JOIN c5 ON c5.part_id = i.part_id
LEFT JOIN c6 ON c6.part_id = i.part_id LEFT JOIN cnt ON cnt.part_id = i.part_id
""")
def q_part_commands(spark, sf_dir):
    d = domain(spark, sf_dir)
    e = d.raw("events")
    et, eid, user = F.col("event_type"), F.col("event_id"), F.col("user_id").cast("string")
    ids = eid.cast("string")
    cost = F.col("value").cast("decimal(18,2)")
    cmds = e.select(
        eid.alias("seq"), "ts", F.when(eid % 5 == 0, F.col("user_id") + 100000000).otherwise(F.col("user_id")).alias("part_id"),
        F.when(et == "purchase", "price").when(et == "error", "discontinue").when(et == "view", "defaults")
         .when(et == "signup", F.when(eid % 2 == 0, "create").otherwise("reactivate"))
         .otherwise(F.when(eid % 3 == 0, "info").otherwise("supplier")).alias("command"),
        cost.alias("new_cost"), (cost * F.lit(1.25).cast("decimal(3,2)")).cast("decimal(18,2)").alias("new_price"),
        (eid % 30).cast("int").alias("new_min"), (eid % 60).cast("int").alias("new_max"), ((eid % 40).cast("int") - 3).alias("new_reorder"),
        F.when(eid % 13 == 0, " ").otherwise(F.concat(F.lit("N-"), user)).alias("new_number"),
        F.when(eid % 11 == 0, "").otherwise(F.concat(F.lit("Name "), ids)).alias("new_name"),
        F.when(eid % 7 != 0, F.concat(F.lit("About "), ids)).alias("new_description"),
        F.concat(F.lit("Group "), (eid % 9).cast("string")).alias("new_category"),
        (eid % 100).alias("new_supplier_id"), F.concat(F.lit("S-"), ids).alias("new_supplier_number"),
        ((eid % 25).cast("int") - 2).alias("new_lead_time"))
    return C.apply_part_commands(d.parts, cmds)


PRICE_CHANGES_SQL = JUDGED_SQL + """
, changes AS (
  SELECT j.part_id, j.seq, j.ts,
         coalesce(lag(j.new_cost) OVER w, p.unit_cost) AS old_cost, j.new_cost,
         coalesce(lag(j.new_price) OVER w, p.unit_price) AS old_price, j.new_price
  FROM judged j JOIN parts p ON p.part_id = j.part_id
  WHERE j.reason IS NULL AND j.command = 'price'
  WINDOW w AS (PARTITION BY j.part_id ORDER BY j.seq))
"""


@register("price_changes", PRICE_CHANGES_SQL + "SELECT * FROM changes")
def q_price_changes(spark, sf_dir):
    d = domain(spark, sf_dir)
    return C.price_changes(d.part_commands, d.parts)


@register("price_change_alerts", PRICE_CHANGES_SQL + """
SELECT *, CASE WHEN old_cost <> 0 THEN cast(abs(new_cost - old_cost) AS double) / cast(old_cost AS double) END
            AS cost_change_ratio
FROM changes
WHERE CASE WHEN old_cost = 0 THEN new_cost <> 0
           ELSE abs(new_cost - old_cost) > abs(old_cost) * CAST(0.10 AS DECIMAL(9,6)) END
""")
def q_price_change_alerts(spark, sf_dir):
    d = domain(spark, sf_dir)
    return C.price_alerts(C.price_changes(d.part_commands, d.parts), "0.10")


VALID_MOVE_SQL = ("(r.new_status = 5 OR (w.st = 0 AND r.new_status = 1) OR (w.st = 1 AND r.new_status = 2) "
                  "OR (w.st = 2 AND r.new_status = 3) OR (w.st = 2 AND r.new_status = 4) "
                  "OR (w.st = 3 AND r.new_status = 2))")

TRANSITIONS_SQL = f"""
, req AS (
  SELECT s.event_id, s.work_order_id, s.ts, s.new_status, w.status AS opening_status,
         row_number() OVER (PARTITION BY s.work_order_id ORDER BY s.ts, s.event_id) AS rn
  FROM status_requests s LEFT JOIN work_orders w ON w.work_order_id = s.work_order_id),
walk AS (
  SELECT work_order_id, CAST(0 AS BIGINT) AS rn, CAST(opening_status AS INT) AS st,
         CAST(NULL AS INT) AS st0, CAST(NULL AS VARCHAR) AS reason
  FROM (SELECT DISTINCT work_order_id, opening_status FROM req) k
  UNION ALL
  SELECT work_order_id, rn, CASE WHEN reason IS NULL THEN new_status ELSE st0 END, st0, reason
  FROM (SELECT r.work_order_id, r.rn, r.new_status, w.st AS st0,
               CASE WHEN w.st IS NULL THEN 'work_order_not_found'
                    WHEN r.new_status IS NULL OR r.new_status NOT BETWEEN 0 AND 5 THEN 'invalid_status'
                    WHEN NOT {VALID_MOVE_SQL} THEN 'invalid_transition' END AS reason
        FROM walk w JOIN req r ON r.work_order_id = w.work_order_id AND r.rn = w.rn + 1) s),
transitions AS (
  SELECT r.event_id, r.work_order_id, r.ts, r.new_status, w.reason IS NULL AS accepted, w.reason,
         w.st0 AS status_before, w.st AS status_after
  FROM req r JOIN walk w ON w.work_order_id = r.work_order_id AND w.rn = r.rn)
"""


def _transitions(spark, sf_dir):
    d = domain(spark, sf_dir)
    return C.apply_transitions(d.status_requests, d.work_orders)


@register("status_transitions", TRANSITIONS_SQL + "SELECT * FROM transitions", recursive=True)
def q_status_transitions(spark, sf_dir):
    return _transitions(spark, sf_dir)


@register("actual_periods", TRANSITIONS_SQL + """
, p AS (SELECT work_order_id, max(ts) FILTER (WHERE new_status = 2) AS actual_start,
               max(ts) FILTER (WHERE new_status = 4) AS done
        FROM transitions WHERE accepted GROUP BY work_order_id)
SELECT work_order_id, actual_start, CASE WHEN done >= actual_start THEN done END AS actual_end,
       (done IS NULL OR done < actual_start) AS is_open_ended
FROM p WHERE actual_start IS NOT NULL
""", recursive=True)
def q_actual_periods(spark, sf_dir):
    return C.actual_periods(_transitions(spark, sf_dir))


@register("notification_recipients", TRANSITIONS_SQL + f"""
, j AS (SELECT t.event_id, t.work_order_id, w.customer_id, t.ts, t.new_status, c.prefer_email, c.prefer_sms
        FROM transitions t JOIN work_orders w ON w.work_order_id = t.work_order_id
        JOIN customers c ON c.customer_id = w.customer_id WHERE t.accepted)
SELECT event_id, work_order_id, customer_id, ts, new_status, 'email' AS channel,
       concat('Work Order ', cast(work_order_id AS varchar), ' Status Update') AS subject,
       concat('Your work order status changed to ', {enum_case_sql('new_status', 'status')}) AS message
FROM j WHERE prefer_email
UNION ALL
SELECT event_id, work_order_id, customer_id, ts, new_status, 'sms', CAST(NULL AS varchar),
       concat('Your equipment is ready! Work order #', cast(work_order_id AS varchar), ' completed.')
FROM j WHERE prefer_sms AND new_status = 4
""", recursive=True)
def q_notification_recipients(spark, sf_dir):
    d = domain(spark, sf_dir)
    return C.recipients(_transitions(spark, sf_dir), d.work_orders, d.customers)


def assign_sql(requests: str) -> str:
    """The queue walked event by event, with the technicians' counts and the orders' holders carried in maps."""
    return f"""
, ev AS (SELECT requested_at AS at, 1 AS kind, work_order_id, technician_id FROM {requests}
         UNION ALL SELECT closed_at, 0, work_order_id, CAST(NULL AS BIGINT) FROM closures),
e AS (SELECT ev.*, row_number() OVER (ORDER BY ev.at, ev.kind, ev.work_order_id, ev.technician_id) AS rn, w.status AS s0, w.technician_id AS t0,
             w.work_order_id IS NOT NULL AS wo_known, t.technician_id IS NOT NULL AS tech_known, coalesce(t.is_active, false) AS tech_active,
             t.status AS ts0, coalesce(t.max_concurrent_jobs, 0) AS tmax
      FROM ev LEFT JOIN dispatch_orders w ON w.work_order_id = ev.work_order_id LEFT JOIN technicians t ON t.technician_id = ev.technician_id),
start AS (SELECT map_from_entries(list({{'k': technician_id, 'v': n}})) AS jobs FROM (
  SELECT t.technician_id, count(w.work_order_id) AS n FROM technicians t
  LEFT JOIN dispatch_orders w ON w.technician_id = t.technician_id AND w.status NOT IN (4, 5) GROUP BY t.technician_id)),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, jobs, MAP {{CAST(-1 AS BIGINT): CAST(-1 AS BIGINT)}} AS holder, MAP {{CAST(-1 AS BIGINT): true}} AS shut,
         MAP {{CAST(-1 AS BIGINT): CAST(0 AS INT)}} AS st, CAST(NULL AS BIGINT) AS h, false AS was_shut, CAST(0 AS BIGINT) AS jb, CAST(0 AS BIGINT) AS ja,
         CAST(NULL AS INT) AS sa, CAST(NULL AS VARCHAR) AS reason, false AS seen
  FROM start
  UNION ALL
  SELECT rn,
         CASE WHEN moves AND takes THEN map_concat(jobs, MAP {{h: jobs[h] - 1, tech: jb + 1}})
              WHEN moves THEN map_concat(jobs, MAP {{h: jobs[h] - 1}}) WHEN takes THEN map_concat(jobs, MAP {{tech: jb + 1}}) ELSE jobs END,
         CASE WHEN kind = 1 AND reason IS NULL THEN map_concat(holder, MAP {{wo: tech}}) ELSE holder END,
         CASE WHEN kind = 0 THEN map_concat(shut, MAP {{wo: true}}) ELSE shut END,
         CASE WHEN kind = 1 AND reason IS NULL AND stn = 0 AND jb + 1 >= tmax THEN map_concat(st, MAP {{tech: 1}}) ELSE st END,
         h, was_shut, jb, CASE WHEN takes THEN jb + 1 ELSE jb END,
         CASE WHEN kind = 1 AND reason IS NULL AND stn = 0 AND jb + 1 >= tmax THEN 1 ELSE stn END, reason, seen
  FROM (SELECT *, kind = 1 AND reason IS NULL AND NOT closed AND h IS DISTINCT FROM tech AS takes,
               NOT closed AND h IS NOT NULL AND h IS DISTINCT FROM tech AND (kind = 0 OR reason IS NULL) AS moves
        FROM (SELECT e.rn, e.kind, e.work_order_id AS wo, e.technician_id AS tech, e.tmax, w.jobs, w.holder, w.shut, w.st,
                     coalesce(w.holder[e.work_order_id], e.t0) AS h, w.holder[e.work_order_id] IS NOT NULL AS seen,
                     w.shut[e.work_order_id] IS NOT NULL AS was_shut,
                     w.shut[e.work_order_id] IS NOT NULL OR coalesce(e.s0 IN (4, 5), false) AS closed,
                     coalesce(w.jobs[e.technician_id], 0) AS jb, coalesce(w.st[e.technician_id], e.ts0) AS stn,
                     CASE WHEN e.kind = 0 THEN NULL WHEN NOT e.wo_known THEN 'work_order_not_found' WHEN NOT e.tech_known THEN 'technician_not_found'
                          WHEN NOT e.tech_active THEN 'technician_inactive'
                          WHEN coalesce(w.st[e.technician_id], e.ts0) = 3 OR coalesce(w.jobs[e.technician_id], 0) >= e.tmax
                            THEN 'technician_at_capacity' END AS reason
              FROM walk w JOIN e ON e.rn = w.rn + 1) a) b),
assigned AS (
  SELECT e.work_order_id, e.technician_id, e.at AS requested_at, w.reason IS NULL AS accepted, w.reason, w.jb AS jobs_before, w.ja AS jobs_after,
         w.sa AS technician_status_after, w.h AS previous_technician_id,
         CASE WHEN w.was_shut THEN 4 WHEN e.s0 = 0 AND (w.reason IS NULL OR w.seen) THEN 1 ELSE e.s0 END AS status_after
  FROM e JOIN walk w ON w.rn = e.rn WHERE e.kind = 1)
"""


# every second open order that a technician holds is closed at its scheduled end; slots are freed inside the batch
CLOSURES_CTE = """
, closures AS (SELECT work_order_id, scheduled_end AS closed_at FROM dispatch_orders
               WHERE technician_id IS NOT NULL AND status NOT IN (4, 5) AND scheduled_end IS NOT NULL AND work_order_id % 8 = 0)
"""


def _closures(d):
    return (d.dispatch_orders.where("technician_id IS NOT NULL AND status NOT IN (4, 5) AND scheduled_end IS NOT NULL AND work_order_id % 8 = 0")
            .select("work_order_id", F.col("scheduled_end").alias("closed_at")))


# a second request for every third order a day later, for another technician: a retry where the first was rejected, else a move
RETRIES_CTE = CLOSURES_CTE + """
, retries AS (SELECT work_order_id, technician_id, requested_at FROM assignment_requests UNION ALL
              SELECT work_order_id, technician_id + 1, requested_at + INTERVAL 1 DAY FROM assignment_requests WHERE work_order_id % 3 = 0)
"""


def _retries(d):
    r = d.assignment_requests.select("work_order_id", "technician_id", "requested_at")
    again = r.where("work_order_id % 3 = 0").select("work_order_id", (F.col("technician_id") + 1).alias("technician_id"),
                                                    (F.col("requested_at") + F.expr("INTERVAL 1 DAY")).alias("requested_at"))
    return r.unionByName(again)


@register("assignment_queue", RETRIES_CTE + assign_sql("retries") + "SELECT * FROM assigned", recursive=True)
def q_assignment_queue(spark, sf_dir):
    d = domain(spark, sf_dir)
    return C.assign_queue(_retries(d), d.dispatch_orders, d.technicians, _closures(d))


@register("reassignment_log", RETRIES_CTE + """
, moves AS (SELECT work_order_id, technician_id, requested_at FROM retries UNION ALL
            SELECT work_order_id, technician_id + 1, created_at + INTERVAL 1 DAY FROM dispatch_orders WHERE technician_id IS NOT NULL)
""" + assign_sql("moves") + """
SELECT work_order_id, previous_technician_id, technician_id AS new_technician_id, requested_at,
       concat('[', strftime(requested_at, '%Y-%m-%d %H:%M'), '] Reassigned from technician ',
              cast(previous_technician_id AS varchar), ' to ', cast(technician_id AS varchar),
              '. Reason: Reassignment request') AS note
FROM assigned
WHERE accepted AND previous_technician_id IS NOT NULL AND previous_technician_id <> technician_id
""", recursive=True)
def q_reassignment_log(spark, sf_dir):
    d = domain(spark, sf_dir)
    moves = d.dispatch_orders.where("technician_id IS NOT NULL").select(
        "work_order_id", (F.col("technician_id") + 1).alias("technician_id"), (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("requested_at"))
    return C.reassignments(C.assign_queue(_retries(d).unionByName(moves), d.dispatch_orders, d.technicians, _closures(d)))


# -- W16 -------------------------------------------------------------------------------------------

def address_error_sql(c: str) -> str:
    """SQL twin of the address parse check: NULL when the text parses (blank and short texts do)."""
    pc = f"string_split({c}, ',')"
    return (f"CASE WHEN {c} IS NULL OR trim({c}) = '' THEN NULL WHEN len({pc}) >= 4 THEN CASE "
            f"WHEN trim({pc}[1]) = '' THEN 'street' WHEN trim({pc}[2]) = '' THEN 'city' "
            f"WHEN trim({pc}[3]) = '' THEN 'state' WHEN trim({pc}[4]) = '' THEN 'zip' "
            f"WHEN NOT regexp_matches(trim({pc}[4]), '^[0-9]{{5}}(-[0-9]{{4}})?$') THEN 'zip' END END")


PEOPLE_SQL = f"""
, tcmd AS (SELECT user_id AS technician_id, event_id AS seq,
                  CASE event_type WHEN 'view' THEN 'status' ELSE 'deactivate' END AS command,
                  CASE WHEN event_type = 'view' THEN cast(event_id % 5 AS int) END AS new_status
           FROM events WHERE event_type IN ('view', 'error')),
tj AS (SELECT c.*, CASE WHEN t.technician_id IS NULL THEN 'technician_not_found'
                        WHEN c.command = 'status' AND coalesce(NOT (c.new_status BETWEEN 0 AND 4), true)
                          THEN 'invalid_status' END AS reason
       FROM tcmd c LEFT JOIN technicians t ON t.technician_id = c.technician_id),
tu AS (SELECT technician_id,
              arg_max(CASE WHEN command = 'deactivate' THEN 4 ELSE new_status END, seq) AS n_status,
              bool_or(command = 'deactivate') AS deactivated
       FROM tj WHERE reason IS NULL GROUP BY technician_id),
tc AS (SELECT technician_id, count(*) FILTER (WHERE reason IS NULL) AS applied,
              count(*) FILTER (WHERE reason IS NOT NULL) AS rejected FROM tj GROUP BY technician_id),
ccmd AS (SELECT user_id AS customer_id, event_id AS seq,
                CASE event_type WHEN 'signup' THEN 'preferences' WHEN 'click' THEN 'address' ELSE 'contact' END AS command,
                CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN ' '
                     ELSE concat('c', cast(user_id AS varchar), '@example.com') END END AS new_email,
                CASE WHEN event_type = 'purchase' THEN concat('Contact ', cast(event_id % 50 AS varchar)) END AS new_contact_name,
                CASE WHEN event_type = 'purchase' AND event_id % 6 <> 0 THEN concat('555-', lpad(cast(event_id % 10000 AS varchar), 4, '0')) END AS new_phone,
                CASE WHEN event_type = 'click' THEN
                  CASE WHEN event_id % 7 = 0 THEN concat(cast(event_id AS varchar), ' Oak Ave')
                       WHEN event_id % 11 = 0 THEN concat(cast(event_id AS varchar), ' Oak Ave, Dallas, tx, 123')
                       ELSE concat(cast(event_id AS varchar), ' Oak Ave, Dallas, tx, ',
                                   lpad(cast(10000 + event_id % 89999 AS varchar), 5, '0')) END END AS new_address,
                CASE WHEN event_type = 'signup' THEN event_id % 2 = 0 END AS new_prefer_email,
                CASE WHEN event_type = 'signup' THEN event_id % 3 = 0 END AS new_prefer_sms
         FROM events WHERE event_type IN ('signup', 'click', 'purchase')),
cj AS (SELECT c.*, CASE WHEN k.customer_id IS NULL THEN 'customer_not_found'
                        WHEN c.command = 'contact' AND (c.new_email IS NULL OR trim(c.new_email) = '') THEN 'email_required'
                        WHEN c.command = 'address' AND ({address_error_sql('c.new_address')}) IS NOT NULL
                          THEN 'invalid_address' END AS reason
       FROM ccmd c LEFT JOIN customers k ON k.customer_id = c.customer_id),
cu AS (SELECT customer_id,
              arg_max(new_email, seq) FILTER (WHERE command = 'contact') AS n_email,
              arg_max(new_contact_name, seq) FILTER (WHERE command = 'contact') AS n_contact,
              max_by(struct_pack(v := new_phone), seq) FILTER (WHERE command = 'contact') AS n_phone,
              arg_max(new_address, seq) FILTER (WHERE command = 'address') AS n_address,
              bool_or(command = 'preferences') AS has_pref,
              arg_max(new_prefer_email, seq) FILTER (WHERE command = 'preferences') AS n_pe,
              arg_max(new_prefer_sms, seq) FILTER (WHERE command = 'preferences') AS n_ps
       FROM cj WHERE reason IS NULL GROUP BY customer_id),
cc AS (SELECT customer_id, count(*) FILTER (WHERE reason IS NULL) AS applied,
              count(*) FILTER (WHERE reason IS NOT NULL) AS rejected FROM cj GROUP BY customer_id)
"""


@register("technician_customer_commands", PEOPLE_SQL + """
SELECT 'technician' AS kind, t.technician_id AS person_id,
       cast(coalesce(u.n_status, t.status) AS int) AS status,
       CASE WHEN u.deactivated THEN false ELSE t.is_active END AS is_active,
       CAST(NULL AS varchar) AS contact_name, CAST(NULL AS varchar) AS phone,
       CAST(NULL AS varchar) AS email, CAST(NULL AS varchar) AS address,
       CAST(NULL AS boolean) AS prefer_email, CAST(NULL AS boolean) AS prefer_sms,
       coalesce(c.applied, 0) AS commands_applied, coalesce(c.rejected, 0) AS commands_rejected
FROM technicians t LEFT JOIN tu u ON u.technician_id = t.technician_id LEFT JOIN tc c ON c.technician_id = t.technician_id
UNION ALL
SELECT 'customer', k.customer_id, CAST(NULL AS int), true, u.n_contact, u.n_phone.v, u.n_email, coalesce(u.n_address, k.address),
       CASE WHEN u.has_pref THEN u.n_pe ELSE k.prefer_email END,
       CASE WHEN u.has_pref THEN u.n_ps ELSE k.prefer_sms END,
       coalesce(c.applied, 0), coalesce(c.rejected, 0)
FROM customers k LEFT JOIN cu u ON u.customer_id = k.customer_id LEFT JOIN cc c ON c.customer_id = k.customer_id
""")
def q_technician_customer_commands(spark, sf_dir):
    d = domain(spark, sf_dir)
    e = d.raw("events")
    et, eid = F.col("event_type"), F.col("event_id")
    tcmd = e.where(et.isin("view", "error")).select(
        F.col("user_id").alias("technician_id"), eid.alias("seq"),
        F.when(et == "view", "status").otherwise("deactivate").alias("command"),
        F.when(et == "view", (eid % 5).cast("int")).alias("new_status"))
    addr = (F.when(eid % 7 == 0, F.concat(eid.cast("string"), F.lit(" Oak Ave")))
             .when(eid % 11 == 0, F.concat(eid.cast("string"), F.lit(" Oak Ave, Dallas, tx, 123")))
             .otherwise(F.concat(eid.cast("string"), F.lit(" Oak Ave, Dallas, tx, "),
                                 F.lpad((10000 + eid % 89999).cast("string"), 5, "0"))))
    ccmd = e.where(et.isin("signup", "click", "purchase")).select(
        F.col("user_id").alias("customer_id"), eid.alias("seq"),
        F.when(et == "signup", "preferences").when(et == "click", "address").otherwise("contact").alias("command"),
        F.when(et == "purchase", F.when(eid % 4 == 0, F.lit(" "))
               .otherwise(F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit("@example.com"))))
         .alias("new_email"),
        F.when(et == "purchase", F.concat(F.lit("Contact "), (eid % 50).cast("string"))).alias("new_contact_name"),
        F.when((et == "purchase") & (eid % 6 != 0), F.concat(F.lit("555-"), F.lpad((eid % 10000).cast("string"), 4, "0"))).alias("new_phone"),
        F.when(et == "click", addr).alias("new_address"),
        F.when(et == "signup", eid % 2 == 0).alias("new_prefer_email"),
        F.when(et == "signup", eid % 3 == 0).alias("new_prefer_sms"))
    t = C.apply_technician_commands(d.technicians, tcmd)
    c = C.apply_customer_commands(d.customers, ccmd)
    tech = t.select(F.lit("technician").alias("kind"), F.col("technician_id").alias("person_id"), "status",
                    "is_active", F.lit(None).cast("string").alias("contact_name"), F.lit(None).cast("string").alias("phone"),
                    F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("address"),
                    F.lit(None).cast("boolean").alias("prefer_email"), F.lit(None).cast("boolean").alias("prefer_sms"),
                    "commands_applied", "commands_rejected")
    cust = c.select(F.lit("customer").alias("kind"), F.col("customer_id").alias("person_id"),
                    F.lit(None).cast("int").alias("status"), "is_active", "contact_name", "phone", "email", "address", "prefer_email",
                    "prefer_sms", "commands_applied", "commands_rejected")
    return tech.unionByName(cust)


# -- W17 -------------------------------------------------------------------------------------------

WO_CMDS_SQL = TRANSITIONS_SQL + """
, cm AS (
  SELECT user_id AS work_order_id, event_id AS seq, ts,
         CASE event_type WHEN 'view' THEN 'schedule' WHEN 'click' THEN 'estimate' WHEN 'purchase' THEN 'actuals'
              ELSE 'add_part' END AS command,
         CASE WHEN event_type = 'view' THEN ts END AS new_start,
         CASE WHEN event_type = 'view' THEN ts + INTERVAL 1 HOUR * (event_id % 48 - 4) END AS new_end,
         CASE WHEN event_type = 'click' THEN cast(event_id % 50 - 5 AS decimal(8,2))
              WHEN event_type = 'purchase' THEN cast(event_id % 12 + 1 AS decimal(8,2)) END AS hours,
         CASE WHEN event_type IN ('click', 'purchase') THEN cast(value AS decimal(18,2)) END AS cost,
         row_number() OVER () AS rid
  FROM events WHERE event_type <> 'error'),
tl AS (SELECT work_order_id, ts, event_id AS seq, 0 AS kind, status_after AS st, CAST(NULL AS BIGINT) AS rid
       FROM transitions WHERE accepted
       UNION ALL SELECT work_order_id, ts, seq, 1, CAST(NULL AS INT), rid FROM cm),
cmd_status AS (SELECT rid, kind, last_value(st IGNORE NULLS) OVER (PARTITION BY work_order_id ORDER BY ts, seq, kind
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st_now FROM tl),
judged AS (
  SELECT cm.*, coalesce(a.st_now, w.status) AS status_at,
         CASE WHEN coalesce(a.st_now, w.status) IS NULL THEN 'work_order_not_found'
              WHEN cm.command = 'schedule' AND cm.new_start > cm.new_end THEN 'start_after_end'
              WHEN cm.command = 'estimate' AND cm.hours < 0 THEN 'negative_hours'
              WHEN cm.command IN ('estimate', 'actuals') AND cm.cost < 0 THEN 'negative_amount'
              WHEN cm.command = 'actuals' AND coalesce(a.st_now, w.status) <> 4 THEN 'not_completed' END AS reason
  FROM cm JOIN cmd_status a ON a.rid = cm.rid AND a.kind = 1 LEFT JOIN work_orders w ON w.work_order_id = cm.work_order_id),
upd AS (
  SELECT work_order_id,
         bool_or(command = 'schedule') AS has_s, arg_max(new_start, (ts, seq)) FILTER (WHERE command = 'schedule') AS n_s,
         arg_max(new_end, (ts, seq)) FILTER (WHERE command = 'schedule') AS n_e,
         bool_or(command = 'estimate') AS has_e, arg_max(hours, (ts, seq)) FILTER (WHERE command = 'estimate') AS n_eh,
         arg_max(cost, (ts, seq)) FILTER (WHERE command = 'estimate') AS n_ec,
         bool_or(command = 'actuals') AS has_a, arg_max(hours, (ts, seq)) FILTER (WHERE command = 'actuals') AS n_ah,
         arg_max(cost, (ts, seq)) FILTER (WHERE command = 'actuals') AS n_ac,
         count(*) FILTER (WHERE command = 'add_part') AS n_lines
  FROM judged WHERE reason IS NULL GROUP BY work_order_id),
cnt AS (SELECT work_order_id, count(*) FILTER (WHERE reason IS NULL) AS applied,
               count(*) FILTER (WHERE reason IS NOT NULL) AS rejected FROM judged GROUP BY work_order_id)
"""


@register("work_order_commands", WO_CMDS_SQL + """
SELECT w.work_order_id, w.status,
       CASE WHEN u.has_s THEN u.n_s ELSE w.scheduled_start END AS scheduled_start,
       CASE WHEN u.has_s THEN u.n_e ELSE w.scheduled_end END AS scheduled_end,
       cast(CASE WHEN u.has_e THEN u.n_eh WHEN w.estimated_labor_hours > 0 THEN w.estimated_labor_hours ELSE 0 END
            AS decimal(8,2)) AS estimated_labor_hours,
       cast(CASE WHEN u.has_e THEN u.n_ec WHEN w.estimated_labor_hours > 0 THEN w.estimated_cost END
            AS decimal(18,2)) AS estimated_cost,
       cast(CASE WHEN u.has_a THEN u.n_ah END AS decimal(8,2)) AS actual_labor_hours,
       cast(CASE WHEN u.has_a THEN u.n_ac ELSE w.actual_cost END AS decimal(18,2)) AS actual_cost,
       coalesce(u.n_lines, 0) AS added_lines,
       coalesce(c.applied, 0) AS commands_applied, coalesce(c.rejected, 0) AS commands_rejected
FROM work_orders w LEFT JOIN upd u ON u.work_order_id = w.work_order_id LEFT JOIN cnt c ON c.work_order_id = w.work_order_id
""", recursive=True)
def q_work_order_commands(spark, sf_dir):
    d = domain(spark, sf_dir)
    e = d.raw("events").where(F.col("event_type") != "error")
    et, eid = F.col("event_type"), F.col("event_id")
    cmds = e.select(
        F.col("user_id").alias("work_order_id"), eid.alias("seq"), "ts",
        F.when(et == "view", "schedule").when(et == "click", "estimate").when(et == "purchase", "actuals")
         .otherwise("add_part").alias("command"),
        F.when(et == "view", F.col("ts")).alias("new_start"),
        F.when(et == "view", F.col("ts") + F.make_dt_interval(hours=(eid % 48 - 4).cast("int"))).alias("new_end"),
        F.when(et == "click", (eid % 50 - 5).cast("decimal(8,2)"))
         .when(et == "purchase", (eid % 12 + 1).cast("decimal(8,2)")).alias("hours"),
        F.when(et.isin("click", "purchase"), F.col("value").cast("decimal(18,2)")).alias("cost"),
        F.when(et == "signup", eid % 1000).alias("part_id"),
        F.when(et == "signup", (eid % 5).cast("int")).alias("quantity"))
    return C.apply_wo_commands(d.work_orders, cmds, _transitions(spark, sf_dir))


# -- W18 -------------------------------------------------------------------------------------------

@register("work_order_completion", TRANSITIONS_SQL + """
, per AS (SELECT work_order_id, max(ts) FILTER (WHERE new_status = 2) AS actual_start
          FROM transitions WHERE accepted GROUP BY work_order_id),
done AS (SELECT work_order_id, ts AS completed_at, event_id FROM transitions WHERE accepted AND new_status = 4),
unused AS (SELECT work_order_id, inventory_id,
                  sum(CASE WHEN transaction_type = 'Reservation' THEN quantity ELSE 0 END)
                  + sum(CASE WHEN transaction_type IN ('Issue', 'Release') THEN quantity ELSE 0 END) AS unused
           FROM inventory_transactions WHERE work_order_id IS NOT NULL GROUP BY work_order_id, inventory_id),
rel AS (SELECT d.work_order_id, count(*) AS release_lines, sum(u.unused) AS release_units
        FROM done d JOIN unused u ON u.work_order_id = d.work_order_id WHERE u.unused > 0 GROUP BY d.work_order_id),
j AS (SELECT d.*, w.customer_id, w.actual_cost,
             coalesce(CASE WHEN p.actual_start IS NOT NULL
                           THEN (epoch_us(d.completed_at) - epoch_us(p.actual_start)) / 3600000000.0 END,
                      cast(w.estimated_labor_hours AS double)) AS actual_labor_hours
      FROM done d LEFT JOIN work_orders w ON w.work_order_id = d.work_order_id
      LEFT JOIN per p ON p.work_order_id = d.work_order_id)
SELECT j.work_order_id, j.event_id, j.customer_id, j.completed_at, j.actual_cost AS invoice_amount,
       j.completed_at + INTERVAL 30 DAY AS due_date, j.actual_labor_hours,
       j.actual_labor_hours > 0 AND j.actual_cost > 0 AS actuals_valid,
       coalesce(r.release_lines, 0) AS release_lines, cast(coalesce(r.release_units, 0) AS bigint) AS release_units
FROM j LEFT JOIN rel r ON r.work_order_id = j.work_order_id
""", recursive=True)
def q_work_order_completion(spark, sf_dir):
    d = domain(spark, sf_dir)
    tr = _transitions(spark, sf_dir)
    invoices, _releases = C.complete(tr, d.work_orders, d.inventory_transactions)
    return invoices
