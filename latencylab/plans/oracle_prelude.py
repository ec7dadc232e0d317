"""DuckDB spelling of the derived tables, as CTEs ahead of each oracle query.

The first block is the fixture definition of FIXTURES.md (with DuckDB's
``epoch_us(ts) // 1000`` for epoch milliseconds). The second block restates the
stored tables (run starts, bucket and run rollups, the three-source split,
resource alignment) in plain SQL so the oracle checks the Spark operators that
build them, not a copy of their output. Which source answers for a run is decided by
rank over all stored rows, unlike the anti joins of the Spark side.
"""

FIXTURE_CTES = [
    ("fx_base", """
select event_id as src_id, user_id, event_type, value, epoch_us(ts) // 1000 as ts_ms,
  case when user_id % 2 = 0 then 'spark' else 'flink' end as framework,
  case user_id % 5 when 0 then 'low' when 1 then 'medium' when 2 then 'high'
       when 3 then 'fault_medium' else 'fault_high' end as scenario,
  lpad(cast(cast(floor(user_id / 10) as bigint) % 5 + 1 as varchar), 2, '0') as iteration
from events"""),
    ("fx_seq", """
select b.*, concat(framework, '_', scenario, '_', iteration) as run_id,
  1704067200000 + cast(floor((ts_ms - 1704067200000) / 10000) as bigint) as sent_at_ms,
  cast(row_number() over (partition by framework, scenario, iteration order by src_id) as bigint) as event_id
from fx_base b"""),
    ("transactions", """
select run_id, event_id, case when event_id % 59 <> 0 then sent_at_ms end as sent_at_ms, scenario, framework, iteration,
  concat('T', cast(src_id as varchar)) as TransactionID,
  case when event_id % 61 = 0 then null else concat('A', cast(user_id as varchar)) end as AccountID,
  case when event_id % 53 = 0 then null else round(value * 50, 2) end as TransactionAmount,
  case when event_type in ('purchase', 'click') then 'Debit' else 'Credit' end as TransactionType,
  case src_id % 5 when 0 then 'Online' when 1 then 'Mobile' when 2 then 'ATM'
       when 3 then 'Branch' end as Channel,
  18 + (user_id * 7) % 75 as CustomerAge,
  1 + src_id % 5 as LoginAttempts,
  round(value * 1000, 2) as AccountBalance,
  concat('M', cast(src_id % 100 as varchar)) as MerchantID,
  cast(floor(event_id / 10) as bigint) as batch_id
from fx_seq"""),
    ("fx_kept", """
select run_id, framework, scenario, iteration, event_id, case when event_id % 59 <> 0 then sent_at_ms end as sent_at_ms,
  sent_at_ms + cast(floor(value * 10) as bigint) as processed_at_ms,
  sent_at_ms + cast(floor(value * 10) as bigint) + event_id % 7 as collected_at_ms,
  case when event_id % 113 = 0 then null else cast(floor(value * 10) as double) end as latency_ms
from fx_seq where event_id % 97 <> 0"""),
    ("processed_events_all", """
select * from fx_kept
union all
select run_id, framework, scenario, iteration, event_id, sent_at_ms, processed_at_ms,
  collected_at_ms + 50 as collected_at_ms, latency_ms
from fx_kept where event_id % 89 = 0"""),
    ("runs", """
select run_id, framework, scenario, iteration, min(sent_at_ms) as run_start_ms,
  max(sent_at_ms) as run_end_ms
from fx_seq group by run_id, framework, scenario, iteration"""),
    ("run_metadata", """
select run_id, framework, scenario, iteration,
  case when scenario like 'fault%' then 'fault' else 'normal' end as mode,
  cast(case scenario when 'low' then 50 when 'high' then 400 when 'fault_high' then 400
       else 100 end as double) as eps,
  cast(250 as double) as duration_seconds,
  cast(null as integer) as max_events,
  cast(null as varchar) as fault_service,
  cast(null as varchar) as fault_action,
  cast(null as integer) as fault_count
from runs where iteration <> '05'"""),
    ("fx_fault_runs", """
select run_id, run_start_ms, case when framework = 'spark' then 'spark-worker' else 'taskmanager' end as service,
  case when iteration in ('01', '03', '05') then 'kill' else 'stop-start' end as action,
  run_start_ms + 120000 as start_ms,
  run_start_ms + 120000 + case when iteration in ('01', '03', '05') then 200 else 11200 end as end_ms,
  iteration
from runs where scenario like 'fault%'"""),
    ("fault_events", """
select run_id, service, '' as container, action, 'fault_start' as phase, start_ms as timestamp_ms from fx_fault_runs
union all
select run_id, service, concat(service, '-1') as container, action, 'container_fault_start' as phase, start_ms from fx_fault_runs
union all
select run_id, service, '' as container, action, 'fault_end' as phase, end_ms from fx_fault_runs where iteration <> '04'
union all
select run_id, service, concat(service, '-1') as container, action, 'container_fault_end' as phase, end_ms from fx_fault_runs where iteration <> '04'"""),
    ("fx_steps", """
select distinct run_id, framework, scenario, run_start_ms,
  cast(floor((sent_at_ms - run_start_ms) / 5000) as bigint) as k
from fx_seq join runs using (run_id, framework, scenario, iteration)"""),
    ("resource_samples", """
select run_id, '/docker/a' as id, k, run_start_ms + k * 5000 as timestamp_ms,
  cast(case when k >= 30 then k - 30 else k end * 2.5 as double) as cpu_seconds_total,
  case when k = 7 then cast('NaN' as double) else cast(100000000 + k * 1000000 as double) end as memory_bytes
from fx_steps
union all
select run_id, '/docker/b' as id, k, run_start_ms + k * 5000 as timestamp_ms,
  cast(k * 1.25 as double) as cpu_seconds_total, cast(200000000 as double) as memory_bytes
from fx_steps where k % 11 <> 3
union all
select run_id, '/host/x' as id, k, run_start_ms + k * 5000 as timestamp_ms,
  cast(k * 9.0 as double) as cpu_seconds_total, cast(900000000 as double) as memory_bytes
from fx_steps"""),
]

STORED_CTES = [
    ("run_starts", """
select f.run_id, f.event_id as first_event_id, f.sent_at_ms as first_record_sent_at_ms,
  f.collected_at_ms as first_collected_at_ms, m.eps,
  case when f.sent_at_ms is null then f.collected_at_ms
       when f.event_id is null or nullif(m.eps, 0) is null then f.sent_at_ms
       else f.sent_at_ms - cast(round_even((f.event_id - 1) * cast(1000 as double) / nullif(m.eps, 0), 0) as bigint)
  end as run_start_ms
from (select *, row_number() over (partition by run_id order by collected_at_ms, event_id) as rn
      from processed_events_all where collected_at_ms is not null) f
left join run_metadata m using (run_id)
where f.rn = 1"""),
    ("all_buckets", """
select run_id, max(iteration) as iteration, max(framework) as framework, max(scenario) as scenario,
  bucket_offset_ms,
  min(run_start_ms) + bucket_offset_ms as bucket_start_ms,
  min(run_start_ms) + bucket_offset_ms + 5000 as bucket_end_ms,
  count(*) as messages, count(distinct event_id) as distinct_events,
  min(event_id) as min_event_id, max(event_id) as max_event_id,
  avg(latency_ms) as avg_latency_ms,
  percentile_disc(0.5) within group (order by latency_ms) as median_latency_ms,
  percentile_disc(0.95) within group (order by latency_ms) as p95_latency_ms,
  max(latency_ms) as max_latency_ms
from (select e.*, s.run_start_ms,
        (e.collected_at_ms - s.run_start_ms) - (((e.collected_at_ms - s.run_start_ms) % 5000) + 5000) % 5000 as bucket_offset_ms
      from processed_events_all e join run_starts s using (run_id)
      where e.collected_at_ms is not null) x
group by run_id, bucket_offset_ms"""),
    ("all_summaries", """
select e.run_id, max(iteration) as iteration, max(framework) as framework, max(scenario) as scenario,
  count(*) as messages, count(distinct event_id) as distinct_events,
  min(event_id) as min_event_id, max(event_id) as max_event_id,
  min(s.run_start_ms) as first_sent_at_ms,
  min(collected_at_ms) as first_collected_at_ms, max(collected_at_ms) as last_collected_at_ms,
  avg(latency_ms) as avg_latency_ms,
  percentile_disc(0.5) within group (order by latency_ms) as median_latency_ms,
  percentile_disc(0.95) within group (order by latency_ms) as p95_latency_ms,
  max(latency_ms) as max_latency_ms
from processed_events_all e join run_starts s using (run_id)
where e.collected_at_ms is not null
group by e.run_id"""),
    ("processed_event_buckets", """
select * exclude (iteration) from all_buckets where iteration in ('01', '02', '05')"""),
    ("processed_run_summaries", """
select * exclude (iteration) from all_summaries where iteration in ('01', '02')"""),
    ("processed_events", """
select * exclude (iteration) from processed_events_all where iteration in ('03', '04')"""),
    # Every stored row of every source in one shape, ranked by which source answers for its run.
    ("source_rows", """
select run_id, 1 as rank, framework, scenario, messages as n, min_event_id as lo, max_event_id as hi,
  first_sent_at_ms as sent, first_collected_at_ms as got, last_collected_at_ms as got_last,
  avg_latency_ms as mean, p95_latency_ms as high, coalesce(first_sent_at_ms, first_collected_at_ms) as origin
from processed_run_summaries
union all by name
select run_id, 2 as rank, framework, scenario, 1 as n, event_id as lo, event_id as hi, sent_at_ms as sent,
  collected_at_ms as got, collected_at_ms as got_last, latency_ms as mean, coalesce(sent_at_ms, collected_at_ms) as origin
from processed_events
union all by name
select run_id, 3 as rank, framework, scenario, messages as n, min_event_id as lo, max_event_id as hi,
  bucket_start_ms as got, bucket_end_ms as got_last, avg_latency_ms as mean, p95_latency_ms as high, bucket_start_ms as origin
from processed_event_buckets"""),
    ("event_runs", """
select run_id, list_extract(['summary', 'raw', 'buckets'], rank) as source, min(framework) as event_framework,
  min(scenario) as event_scenario, cast(sum(n) as bigint) as messages, min(lo) as min_event_id, max(hi) as max_event_id,
  min(sent) as first_sent_at_ms, min(got) as first_collected_at_ms, max(got_last) as last_collected_at_ms,
  case rank when 1 then max(mean) when 2 then avg(mean) else sum(mean * n) / nullif(sum(n), 0) end as avg_latency_ms,
  case rank when 2 then quantile_cont(mean, 0.95) else avg(high) end as p95_latency_ms,
  min(origin) as first_ts
from (select *, min(rank) over (partition by run_id) as best from source_rows) where rank = best
group by run_id, rank"""),
    ("fault_summary", """
select run_id, max(if(opens, service, null)) as inferred_fault_service, max(if(opens, action, null)) as inferred_fault_action,
  cast(null as integer) as inferred_fault_count, cast(count_if(opens) as bigint) as fault_start_count,
  cast(count_if(closes) as bigint) as fault_end_count
from (select *, phase = 'fault_start' as opens, phase = 'fault_end' as closes from fault_events) group by run_id"""),
    # What the metadata declares about a run (a normal run has no fault, an empty name is none) ...
    ("declared", """
select run_id, framework, scenario, iteration, mode, eps, duration_seconds, max_events, fault_count,
  if(mode is distinct from 'normal' and fault_service <> '', fault_service, null) as fault_service,
  if(mode is distinct from 'normal' and fault_action <> '', fault_action, null) as fault_action
from run_metadata"""),
    # ... and what its events, id and fault log suggest.
    ("suggested", """
select e.run_id, event_framework as framework, event_scenario as scenario, split_part(e.run_id, '_', 3) as iteration,
  if(f.run_id is null, 'normal', 'fault') as mode, inferred_fault_service as fault_service,
  inferred_fault_action as fault_action, inferred_fault_count as fault_count
from event_runs e left join fault_summary f using (run_id)"""),
    ("resolved_runs", "select e.*, " + ", ".join(
        f"coalesce(d.{c}, s.{c}) as {c}" for c in ("framework", "scenario", "iteration", "mode", "fault_service", "fault_action", "fault_count")
    ) + ", d.eps, d.duration_seconds, d.max_events from event_runs e join suggested s using (run_id) left join declared d using (run_id)"),
    ("res_runs", """
select r.run_id, r.framework, r.scenario, first_ts as run_start_at_ms, first_collected_at_ms, last_collected_at_ms,
  coalesce(d.mode, if(contains(r.run_id, '_fault_'), 'fault', 'normal')) as mode
from resolved_runs r left join declared d using (run_id)
where first_ts is not null and last_collected_at_ms is not null"""),
    ("docker_samples", """
select * from resource_samples
where regexp_full_match(id, '/docker/.+|/system[.]slice/docker-.+[.]scope')"""),
    ("mem_total", """
select run_id, timestamp_ms, sum(memory_bytes) as memory_working_set_bytes, count(*) as series
from docker_samples group by run_id, timestamp_ms"""),
    ("cpu_inc", """
select run_id, id, timestamp_ms,
  case when lag(cpu_seconds_total) over w is null then 0.0
       when cpu_seconds_total >= lag(cpu_seconds_total) over w then cpu_seconds_total - lag(cpu_seconds_total) over w
       else cpu_seconds_total end as inc
from docker_samples
window w as (partition by run_id, id order by timestamp_ms)"""),
    ("cpu_rate", """
select run_id, id, timestamp_ms,
  sum(inc) over r - first_value(inc) over r as increase,
  count(*) over r as n,
  (max(timestamp_ms) over r - min(timestamp_ms) over r) / 1000.0 as span_s
from cpu_inc
window r as (partition by run_id, id order by timestamp_ms range between 29999 preceding and current row)"""),
    ("cpu_total", """
select run_id, timestamp_ms,
  sum(case when n >= 2 and span_s > 0 then increase / span_s end) as cpu_usage_cores
from cpu_rate group by run_id, timestamp_ms"""),
    ("mem_aligned", """
select m.run_id, greatest(0, m.timestamp_ms - r.run_start_at_ms) as bucket_offset_ms,
  arg_max(m.memory_working_set_bytes, m.timestamp_ms) as memory_working_set_bytes
from mem_total m join res_runs r on m.run_id = r.run_id
where m.timestamp_ms >= r.run_start_at_ms and m.timestamp_ms <= r.last_collected_at_ms
  and isfinite(m.memory_working_set_bytes)
group by m.run_id, greatest(0, m.timestamp_ms - r.run_start_at_ms)"""),
    ("cpu_aligned", """
select c.run_id, greatest(0, c.timestamp_ms - r.run_start_at_ms) as bucket_offset_ms,
  arg_max(c.cpu_usage_cores, c.timestamp_ms) as cpu_usage_cores
from cpu_total c join res_runs r on c.run_id = r.run_id
where c.timestamp_ms >= r.run_start_at_ms and c.timestamp_ms <= r.last_collected_at_ms
  and isfinite(c.cpu_usage_cores)
group by c.run_id, greatest(0, c.timestamp_ms - r.run_start_at_ms)"""),
    ("resource_usage_buckets", """
select r.run_id, r.framework, r.scenario, x.bucket_offset_ms,
  r.run_start_at_ms + x.bucket_offset_ms as bucket_start_ms,
  r.run_start_at_ms + x.bucket_offset_ms + 5000 as bucket_end_ms,
  x.memory_working_set_bytes, x.cpu_usage_cores, 'prometheus:docker_total' as source
from (select coalesce(m.run_id, c.run_id) as run_id,
        coalesce(m.bucket_offset_ms, c.bucket_offset_ms) as bucket_offset_ms,
        m.memory_working_set_bytes, c.cpu_usage_cores
      from mem_aligned m full outer join cpu_aligned c
        on m.run_id = c.run_id and m.bucket_offset_ms = c.bucket_offset_ms) x
join res_runs r on r.run_id = x.run_id"""),
]

ALL_CTES = FIXTURE_CTES + STORED_CTES


def with_prelude(body: str, extra=()) -> str:
    """Prefix a query body with every derived-table CTE, then the query's own."""
    ctes = ",\n".join(f"{name} as ({sql.strip()})" for name, sql in [*ALL_CTES, *extra])
    return f"with {ctes}\n{body.strip()}"
