"""Queries over change feeds, repeated deliveries and nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import changes, delivery, nested
from corpusloom.plans.registry import Registry, table

_KEYED = """
requests AS (SELECT request_id, max(index_name) AS index_name, max(idempotency_key) AS request_key FROM bulk_requests GROUP BY request_id),
keyed AS (
  SELECT r.index_name, o.document_id, o.delivery_id, o.sequence_number, lower(trim(o.op_kind)) AS kind,
         coalesce(nullif(lower(trim(o.idempotency_key)), ''), nullif(lower(trim(r.request_key)), '')) AS k,
         CASE WHEN json_valid(o.document_json) THEN json_type(o.document_json) = 'OBJECT' ELSE FALSE END AS whole
  FROM bulk_operations o JOIN requests r USING (request_id)
)"""

_EXISTING = f"""WITH {_KEYED},
changes AS (
  SELECT index_name, document_id, min(sequence_number) AS sequence_number, bool_or(kind = 'delete') AS is_delete, bool_or(whole OR kind = 'delete') AS effective
  FROM keyed WHERE sequence_number IS NOT NULL AND kind IN ('index', 'update', 'delete')
  GROUP BY index_name, document_id, k, CASE WHEN k IS NULL THEN delivery_id END
),
last AS (SELECT *, row_number() OVER (PARTITION BY index_name, document_id ORDER BY sequence_number DESC) AS rn FROM changes WHERE effective)
SELECT index_name, document_id, sequence_number FROM last WHERE rn = 1 AND NOT is_delete"""

_DROPPED = f"""WITH {_KEYED}
SELECT delivery_id FROM (
  SELECT delivery_id, min(delivery_id) OVER (PARTITION BY index_name, document_id, k) AS kept FROM keyed WHERE k IS NOT NULL
) WHERE delivery_id > kept"""

_TRANSACTIONS = """
WITH ops AS (SELECT request_id, op_ordinal, min(sequence_number) AS n FROM bulk_operations WHERE request_id IS NOT NULL GROUP BY 1, 2)
SELECT request_id, count(op_ordinal) AS ops, count(n) AS committed, count(op_ordinal) = max(op_ordinal) + 1 AS complete,
       min(n) AS first_number, max(n) AS last_number
FROM ops GROUP BY request_id"""

_WATERMARK = f"""WITH {_KEYED},
numbers AS (SELECT DISTINCT index_name, sequence_number AS n FROM keyed WHERE sequence_number IS NOT NULL AND index_name IS NOT NULL),
gaps AS (SELECT *, lag(n) OVER (PARTITION BY index_name ORDER BY n) AS before FROM numbers)
SELECT index_name, coalesce(min(CASE WHEN n - before > 200 THEN before END), max(n)) AS watermark FROM gaps GROUP BY index_name"""

_LOG = """
ops AS (SELECT request_id, op_ordinal, min(sequence_number) AS n FROM bulk_operations WHERE request_id IS NOT NULL AND op_ordinal IS NOT NULL GROUP BY 1, 2),
votes AS (SELECT request_id, n - 2 * op_ordinal AS begin, count(*) AS v FROM ops WHERE n IS NOT NULL GROUP BY 1, 2),
begins AS (SELECT request_id, arg_max(begin, v) AS begin FROM votes GROUP BY 1 HAVING 2 * max(v) > sum(v)),
numbers AS (
  SELECT sequence_number AS n FROM bulk_operations WHERE sequence_number IS NOT NULL
  UNION SELECT begin + 2 * op_ordinal FROM ops JOIN begins USING (request_id)
  WHERE begin + 2 * op_ordinal BETWEEN (SELECT min(sequence_number) FROM bulk_operations) AND (SELECT max(sequence_number) FROM bulk_operations)),
gaps AS (SELECT n, lag(n) OVER (ORDER BY n) AS before FROM numbers),
held AS (SELECT min(f) AS held_from FROM (SELECT min(n) AS f FROM ops GROUP BY request_id HAVING count(*) <> max(op_ordinal) + 1)),
mark AS (SELECT least((SELECT coalesce(min(CASE WHEN n - before > 2 THEN before END), max(n)) FROM gaps), (SELECT held_from - 1 FROM held)) AS watermark)"""

_OPEN = _EXISTING.replace(_KEYED, f"{_LOG},{_KEYED}").replace("WHERE sequence_number IS NOT NULL AND kind", "WHERE sequence_number <= (SELECT watermark FROM mark) AND kind")


def register(reg: Registry) -> None:
    """Add this module's queries."""
    reg.add("p2_found", lambda s, d: changes.replay(table(s, d, "bulk_operations"), table(s, d, "bulk_requests")), _EXISTING)
    reg.add("p2_open", lambda s, d: changes.replay(table(s, d, "bulk_operations"), table(s, d, "bulk_requests"), closed=False), _OPEN)
    reg.add("p2_log_watermark", lambda s, d: changes.log_watermark(table(s, d, "bulk_operations"), closed=False), f"WITH {_LOG} SELECT watermark FROM mark")
    reg.add("p2_transactions", lambda s, d: changes.transactions(table(s, d, "bulk_operations")), _TRANSACTIONS)

    def watermark(s, d):
        flat = changes.with_request(table(s, d, "bulk_operations").where("sequence_number is not null"), table(s, d, "bulk_requests"), [F.col("sequence_number")])
        return changes.contiguous_watermark(flat.where("index_name is not null"), ["index_name"], "sequence_number", step=200)

    reg.add("p2_watermark", watermark, _WATERMARK)
    reg.add("p4_found", lambda s, d: nested.nested_cases(table(s, d, "bulk_operations"), table(s, d, "search_log")))

    def objects(s, d):
        found = nested.all_occurrences(table(s, d, "bulk_operations"), table(s, d, "search_log"))
        return nested.object_store(found).select(F.hex("node_hash").alias("node_hash"), "entities", "content", "occurrences")

    reg.add("p4_objects", objects)

    def bridge(s, d):
        found = nested.all_occurrences(table(s, d, "bulk_operations"), table(s, d, "search_log"))
        return found.withColumns({c: F.hex(c) for c in ("node_hash", "parent_hash")}).drop("content")

    reg.add("p4_bridge", bridge)
    reg.add("p5_found", lambda s, d: delivery.dropped_copies(table(s, d, "bulk_operations"), table(s, d, "bulk_requests")), _DROPPED)
