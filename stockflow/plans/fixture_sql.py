"""The domain-table derivation as one SQL WITH list (from FIXTURES.md).

Used only as the prefix of the DuckDB oracle texts; the Spark side builds the
same tables with the DataFrame API in ``stockflow.sources.domain``.
"""

FIXTURE_WITH = """
WITH
parts AS (
  SELECT p_partkey AS part_id,
         concat('P-', lpad(cast(p_partkey AS string), 8, '0')) AS part_number,
         p_name AS part_name,
         CASE WHEN p_size % 13 = 0 THEN NULL ELSE concat(p_brand, ' ', p_type, ' ', p_name) END AS description,
         p_type AS category,
         cast(cast(p_retailprice AS decimal(18,2)) * cast(60 + p_size % 60 AS decimal(9,0)) * cast(0.01 AS decimal(3,2)) AS decimal(18,2)) AS unit_cost,
         'USD' AS unit_cost_currency,
         cast(CASE WHEN p_partkey % 101 = 0 THEN 0 ELSE p_retailprice END AS decimal(18,2)) AS unit_price,
         CASE WHEN p_partkey % 97 = 1 THEN 'EUR' ELSE 'USD' END AS unit_price_currency,
         CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_partkey % (SELECT count(*) FROM supplier) END AS supplier_id,
         p_size AS lead_time_days,
         cast(p_size % 20 AS int) AS default_minimum_stock_level,
         cast(p_size % 20 + 50 AS int) AS default_maximum_stock_level,
         (p_size % 10 = 0) AS is_discontinued,
         (p_size % 10 <> 0 AND p_size % 7 <> 0) AS is_active
  FROM part),
stock_moves AS (
  SELECT l_partkey AS part_id, n_regionkey AS region_id, l_orderkey, l_linenumber, l_suppkey,
         cast(l_quantity AS int) AS q, l_returnflag AS rf, l_linestatus AS ls, l_shipdate
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
inventory AS (
  SELECT m.part_id * 10 + m.region_id AS inventory_id, m.part_id, r_name AS warehouse,
         concat('B-', lpad(cast(m.part_id % 40 AS string), 2, '0'), '-', cast(m.part_id % 7 AS string)) AS bin_location,
         cast(sum(CASE WHEN rf = 'N' THEN q * 3 ELSE 0 END) AS int) AS quantity_on_hand,
         cast(least(sum(CASE WHEN rf = 'N' THEN q * 3 ELSE 0 END), sum(CASE WHEN rf = 'A' THEN q ELSE 0 END)) AS int) AS quantity_reserved,
         cast(min(m.part_id % 20) AS int) AS minimum_stock_level,
         cast(min(m.part_id % 20) + 50 AS int) AS maximum_stock_level,
         50 AS reorder_quantity,
         ((m.part_id + m.region_id) % 17 <> 0) AS is_active
  FROM stock_moves m JOIN region ON m.region_id = r_regionkey
  GROUP BY m.part_id, m.region_id, r_name),
inventory_transactions AS (
  SELECT concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-', cast(part_id AS string), '-', cast(l_suppkey AS string), '-', cast(cast(l_shipdate AS date) AS string)) AS transaction_id,
         part_id * 10 + region_id AS inventory_id,
         CASE WHEN rf = 'N' THEN 'Receipt' WHEN rf = 'A' AND ls = 'F' THEN 'Reservation' WHEN rf = 'A' THEN 'Issue'
              WHEN ls = 'F' THEN 'Release' ELSE 'Adjustment' END AS transaction_type,
         CASE WHEN rf = 'N' THEN q * 2 WHEN rf = 'A' AND ls = 'F' THEN q WHEN rf = 'A' THEN -q
              WHEN ls = 'F' THEN -q ELSE (CASE WHEN l_linenumber % 2 = 0 THEN q ELSE -q END) END AS quantity,
         CASE WHEN rf = 'N' THEN NULL ELSE l_orderkey END AS work_order_id,
         l_shipdate AS transaction_date
  FROM stock_moves),
technicians AS (
  SELECT s_suppkey AS technician_id, concat('Tech', cast(s_suppkey AS string)) AS first_name, concat('L', cast(s_nationkey AS string)) AS last_name,
         cast(1 + s_nationkey % 4 AS int) AS skill_level, cast(s_suppkey % 5 AS int) AS status,
         cast(2 + s_nationkey % 4 AS int) AS max_concurrent_jobs,
         (s_acctbal > 0 AND s_suppkey % 5 <> 4) AS is_active FROM supplier),
work_orders AS (
  SELECT o_orderkey AS work_order_id,
         concat('WO-', cast(year(o_orderdate) AS string), '-', lpad(cast(10000 + o_orderkey % 89999 AS string), 5, '0')) AS work_order_number,
         o_custkey AS customer_id,
         concat('VIN', lpad(cast(o_custkey AS string), 8, '0'), lpad(cast(o_orderkey % 50 AS string), 6, '0')) AS vin,
         CASE WHEN o_orderkey % 3 = 0 THEN 'Excavator' WHEN o_orderkey % 3 = 1 THEN 'Bulldozer' ELSE 'Crane' END AS equipment_type,
         cast(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 2 ELSE 1 END AS int) AS priority,
         cast(CASE WHEN o_orderkey % 11 = 0 THEN 5 WHEN o_orderstatus = 'F' THEN 4
                   WHEN o_orderstatus = 'P' THEN 2 + o_orderkey % 2 ELSE o_orderkey % 2 END AS int) AS status,
         CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey % (SELECT count(*) FROM supplier) END AS technician_id,
         o_orderdate AS created_at,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + interval '1' day END AS scheduled_start,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + interval '1' day + interval '1' hour * cast(8 + o_orderkey % 90 AS int) END AS scheduled_end,
         cast(o_orderkey % 40 AS decimal(8,2)) AS estimated_labor_hours,
         cast(o_totalprice AS decimal(18,2)) AS estimated_cost,
         cast(cast(o_totalprice AS decimal(18,2)) * cast(80 + o_orderkey % 50 AS decimal(9,0)) * cast(0.01 AS decimal(3,2)) AS decimal(18,2)) AS actual_cost
  FROM orders),
dispatch_orders AS (
  SELECT work_order_id, work_order_number, customer_id, vin, equipment_type, priority, status,
         CASE WHEN status < 4 AND work_order_id % 100 < 4 THEN technician_id END AS technician_id,
         created_at, scheduled_start, scheduled_end, estimated_labor_hours, estimated_cost, actual_cost
  FROM work_orders),
work_order_parts AS (
  SELECT l_orderkey AS work_order_id, l_partkey AS part_id, l_linenumber AS line_no, cast(l_quantity AS int) AS quantity_required, (l_linestatus = 'F') AS is_available FROM lineitem),
customers AS (
  SELECT c_custkey AS customer_id, c_name AS company_name, c_mktsegment AS segment,
         (c_custkey % 3 <> 0) AS prefer_email, (c_custkey % 4 <> 0) AS prefer_sms,
         CASE WHEN c_custkey % 9 = 0 THEN ' ' WHEN c_custkey % 9 = 1 THEN concat(cast(c_custkey AS string), ' Main St')
              WHEN c_custkey % 9 = 2 THEN concat(cast(c_custkey AS string), ' Main St, ', n_name, ', tx, 7500')
              ELSE concat(cast(c_custkey AS string), ' Main St , ', n_name, ', tx, ', lpad(cast(10000 + c_custkey AS string), 5, '0')) END AS address
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
status_requests AS (
  SELECT event_id, user_id AS work_order_id, ts,
         cast(CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 ELSE CASE WHEN event_id % 10 = 0 THEN 5 ELSE 2 END END AS int) AS new_status
  FROM events)
,
part_commands AS (
  SELECT event_id AS seq, ts, user_id AS part_id,
         CASE event_type WHEN 'purchase' THEN 'price' WHEN 'error' THEN 'discontinue' WHEN 'signup' THEN 'reactivate'
              WHEN 'view' THEN 'defaults' ELSE 'supplier' END AS command,
         CASE WHEN event_type = 'purchase' THEN cast(value AS decimal(18,2)) END AS new_cost,
         CASE WHEN event_type = 'purchase' THEN cast(cast(value AS decimal(18,2)) * cast(1.25 AS decimal(3,2)) AS decimal(18,2)) END AS new_price,
         CASE WHEN event_type = 'view' THEN cast(event_id % 30 AS int) END AS new_min,
         CASE WHEN event_type = 'view' THEN cast(event_id % 60 AS int) END AS new_max,
         CASE WHEN event_type = 'click' THEN cast(event_id % 25 AS int) - 2 END AS new_lead_time
  FROM events),
reservation_requests AS (
  SELECT w.work_order_id, p.line_no, p.part_id, p.quantity_required AS quantity, w.created_at
  FROM work_orders w JOIN work_order_parts p ON p.work_order_id = w.work_order_id WHERE w.status IN (0, 1, 2)),
assignment_requests AS (
  SELECT work_order_id, (work_order_id * 7) % (SELECT count(*) FROM supplier) AS technician_id, created_at AS requested_at
  FROM work_orders WHERE status = 0)
"""

AS_OF = "1999-01-01 00:00:00"

# Extra fixture view (FIXTURES.md "gaps": one notification per order from its status).
NOTIFICATIONS_SQL = """
, work_order_notifications AS (
  SELECT work_order_id AS notification_id, work_order_id,
         CASE status WHEN 0 THEN 'Created' WHEN 1 THEN 'Assigned' ELSE 'StatusChanged' END AS notification_type,
         concat('Work order ', work_order_number, ' status ', cast(status AS varchar)) AS subject,
         created_at AS sent_at, (work_order_id % 10 <> 0) AS success,
         CASE WHEN work_order_id % 10 = 0 THEN 'delivery failed' END AS error_message
  FROM work_orders)
"""
