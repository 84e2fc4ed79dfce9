"""DuckDB statements that say the same as the queries, in the direct, row-at-a-time form of each rule.

`STEPS` holds named intermediate views and `RESULTS` the final select of each query; `statements` puts in front of a
result just the steps and test views it needs.
"""
import re

from refreshgate.sources.fixtures import FIRST_MS, NOW_MS, TEMPLATES, duckdb_view

SINCE_MS = NOW_MS - 31 * 86_400_000
TODAY_DAYS = NOW_MS // 86_400_000
WRITES = ("'WRITE', 'MERGE', 'DELETE', 'UPDATE', 'STREAMING UPDATE', 'CREATE TABLE AS SELECT', 'REPLACE TABLE AS SELECT', "
          "'CREATE OR REPLACE TABLE AS SELECT', 'COPY INTO', 'TRUNCATE', 'DLT REFRESH'")
METRICS = ("['numOutputRows', 'numTargetRowsInserted', 'numTargetRowsUpdated', 'numTargetRowsDeleted', 'numUpdatedRows', "
           "'numDeletedRows', 'numCopiedRows']")


def utc(ms: str) -> str:
    return f"coalesce(strftime(make_timestamp({ms} * 1000), '%Y-%m-%d %H:%M:%S.%g') || ' UTC', 'none')"


def names(expression: str) -> str:
    return (f"(case when len({expression}) > 0 then '[''' || array_to_string({expression}, ''', ''') || ''']' "
            "else '[]' end)")


def csv(expression: str) -> str:
    return f"array_to_string(list_sort({expression}), ',')"


SHOWN_ROWS = (f"(select case when len(m) > 0 then array_to_string(m, ', ') else '0 rows' end from (select list_transform("
              f"list_filter({METRICS}, lambda k: metrics[k] is not null and metrics[k] <> '0'), "
              f"lambda k: k || '=' || metrics[k]) as m))")
KEY = "('JOB:' || entity_name)"

STEPS = {
    "last_write": f"""
        select table_name, ts_ms as last_write_ms, operation, operation_metrics as metrics
        from (select *, row_number() over (partition by table_name order by ts_ms desc, version desc) as n
              from table_history where operation in ({WRITES})) where n = 1""",
    "progress": f"""
        select f.dataset, p.* from flow_progress p
        join (select distinct * from flow_definitions) f on f.flow_name = p.flow_name and f.pipeline_id = p.pipeline_id
        where p.ts_ms >= {SINCE_MS}""",
    "last_done": """
        select pipeline_id, dataset, update_id, ts_ms as done_ms
        from (select *, row_number() over (partition by pipeline_id, dataset order by ts_ms desc, update_id desc) as n
              from progress where status = 'COMPLETED') where n = 1""",
    "flow_done": """
        select l.pipeline_id, l.dataset, l.update_id, l.done_ms, cast(sum(p.output_rows) as bigint) as output_rows,
          cast(sum(p.upserted_rows) as bigint) as upserted_rows, cast(sum(p.deleted_rows) as bigint) as deleted_rows
        from last_done l left join progress p
          on p.pipeline_id = l.pipeline_id and p.dataset = l.dataset and p.update_id = l.update_id
        group by all""",
    "flow_table": """
        select * from (
          select m.table_name, d.*, row_number() over (
            partition by m.table_name order by d.done_ms desc, d.update_id desc, d.dataset desc) as n
          from table_meta m join flow_done d on d.pipeline_id = m.pipeline_id
            and (d.dataset = m.table_name or ends_with(m.table_name, '.' || d.dataset))) where n = 1""",
    "flow_signal": """
        select f.table_name, 'pipeline event log, update ' || f.update_id || ': ' || case
          when f.output_rows + f.upserted_rows + f.deleted_rows = 0 then '0 rows' else concat_ws(', ',
            case when f.output_rows <> 0 then 'output_rows=' || f.output_rows end,
            case when f.upserted_rows <> 0 then 'upserted_rows=' || f.upserted_rows end,
            case when f.deleted_rows <> 0 then 'deleted_rows=' || f.deleted_rows end) end as signal
        from flow_table f""",
    "events_done": f"""
        select uc_table_id, max(ts_ms) as done_ms from pipeline_events
        where event_type = 'flow_progress' and status = 'COMPLETED' and ts_ms >= {SINCE_MS} group by 1""",
    "covering": """
        select * from (
          select m.table_name, m.pipeline_id, u.creation_ms as start_ms, u.update_id, row_number() over (
            partition by m.table_name order by u.creation_ms desc, u.update_id desc) as n
          from table_meta m join pipeline_updates u on u.pipeline_id = m.pipeline_id and u.state = 'COMPLETED'
            and (len(u.refresh_selection) = 0 or list_contains(u.refresh_selection, m.table_name)
                 or list_contains(u.refresh_selection, split_part(m.table_name, '.', -1)))) where n = 1""",
    "job_done": """
        select * from (
          select job_id, end_ms as done_ms, run_id, row_number() over (partition by job_id order by start_ms desc, run_id desc) as n
          from job_runs where life_cycle_state in ('TERMINATED', 'SKIPPED', 'INTERNAL_ERROR')
            and result_state = 'SUCCESS') where n = 1""",
    "pipeline_done": """
        select m.table_name, m.pipeline_id, f.done_ms as log_ms,
          case when e.done_ms is null and f.done_ms is null then c.start_ms
            when f.done_ms is null or e.done_ms >= f.done_ms then e.done_ms else f.done_ms end as success_ms,
          case when e.done_ms is null and f.done_ms is null then
              coalesce('pipeline update ' || c.update_id || ' (start time)', 'no completed pipeline run found')
            when f.done_ms is null or e.done_ms >= f.done_ms then 'pipeline_events system table'
            else d.signal end as signal
        from table_meta m left join flow_table f on f.table_name = m.table_name
          left join flow_signal d on d.table_name = m.table_name
          left join events_done e on e.uc_table_id = m.table_id left join covering c on c.table_name = m.table_name
        where m.pipeline_id is not null""",
    "tracker_rows_in": """
        select *, coalesce(nullif(src_group, ''), 'default') as grp, list_filter(src_tables,
          lambda t: not list_contains(coalesce(src_tables_to_skip, []), t)) as tables from tracker""",
    "tracker_sources": """
        select entity_name, entity_type, grp as src_group, refresh_window_btn_tables_in_mins as window_mins,
          unnest(range(len(tables))) as pos, unnest(tables) as table_name from tracker_rows_in""",
    "refreshed_tables": """
        select distinct 'main.demo.t' || s_suppkey as table_name from supplier where s_suppkey % 3 = 0""",
}


UNREADABLE = "(cast(regexp_extract({}, '([0-9]+)$', 1) as bigint) % 6 = 1)"


def status_step(refreshed: str) -> str:
    """The rule for every source; `refreshed` is a condition on table_name."""
    return f"""
        select *, coalesce(is_fresh and basis like '%no rows changed%', false) as met_without_row_changes from (
          select *, case when not is_fresh then null when last_write_ms >= cutoff_ms then 'data write'
              when operation = 'MATERIALIZED_VIEW' then 'producer refresh'
              when signal = 'refreshed by calling upstream job'
                then 'refreshed by calling upstream job, no rows changed in window'
              else 'producer run, no rows changed' end as basis from (
            select *, coalesce(refreshed_at_ms >= cutoff_ms, false) as is_fresh from (
              select entity_name, entity_type, src_group, pos, table_name, window_mins, producer_type, producer_id,
                last_write_ms, operation, metrics, success_ms, signal,
                cast({NOW_MS} - cast(window_mins as bigint) * 60000 as bigint) as cutoff_ms,
                greatest(last_write_ms, success_ms) as refreshed_at_ms,
                case when is_now then greatest(last_write_ms, case when producer_type = 'PIPELINE'
                    then coalesce(log_ms, {NOW_MS}) else {NOW_MS} end)
                  else greatest(last_write_ms, success_ms) end as data_refreshed_at_ms
              from (
                select s.*, {refreshed} as is_now, p.log_ms,
                  case when m.table_type = 'MATERIALIZED_VIEW' then null else w.last_write_ms end as last_write_ms,
                  case when m.table_type = 'MATERIALIZED_VIEW' then m.table_type else w.operation end as operation,
                  w.metrics,
                  case when m.pipeline_id is not null then 'PIPELINE' when t.producer_id is not null then 'JOB'
                    else 'NONE' end as producer_type,
                  coalesce(m.pipeline_id, t.producer_id) as producer_id,
                  cast(case when {refreshed} then {NOW_MS} when m.pipeline_id is not null then p.success_ms
                    when t.producer_id is not null then j.done_ms end as bigint) as success_ms,
                  case when {refreshed} then 'refreshed by calling upstream job'
                    when m.pipeline_id is not null then p.signal
                    when t.producer_id is not null then coalesce('job run ' || j.run_id, 'no successful job run found')
                    end as signal
                from tracker_sources s left join table_meta m on m.table_name = s.table_name
                  left join last_write w on w.table_name = s.table_name
                  left join pipeline_done p on p.table_name = s.table_name
                  left join tracker_producers t on t.entity_name = s.entity_name and t.src_table = s.table_name
                    and t.producer_type = 'JOB'
                  left join job_done j on cast(j.job_id as string) = t.producer_id
                where s.window_mins is not null))))"""


STEPS |= {
    "status": status_step("false"),
    "readable_write": f"select * from last_write where not {UNREADABLE.format('table_name')}",
    "pipeline_log": """
        select m.table_name, m.pipeline_id, f.done_ms as log_ms, f.done_ms as success_ms,
          case when f.done_ms is null then 'no completed pipeline run found' else d.signal end as signal
        from table_meta m left join flow_table f on f.table_name = m.table_name
          left join flow_signal d on d.table_name = m.table_name where m.pipeline_id is not null""",
    "status_few": status_step("false").replace("last_write w ", "readable_write w ").replace("pipeline_done p", "pipeline_log p"),
    "status_now": status_step("(s.table_name in (select table_name from refreshed_tables))"),
    "verdicts": f"""
        select t.entity_name, t.entity_type, t.grp as src_group, t.refresh_window_btn_tables_in_mins as window_mins,
          cast(len(t.tables) as bigint) as n_sources, coalesce(s.n_stale, 0) as n_stale,
          cast({NOW_MS} - cast(t.refresh_window_btn_tables_in_mins as bigint) * 60000 as bigint) as cutoff_ms,
          s.newest_refresh_ms, coalesce(s.stale, []) as stale, coalesce(s.no_change, []) as no_change,
          case when t.refresh_window_btn_tables_in_mins is null or len(t.tables) = 0 then 'UNCHECKED'
            when s.n_stale > 0 then 'STALE' else 'FRESH' end as verdict
        from tracker_rows_in t left join (
          select entity_name, src_group, count(*) filter (not is_fresh) as n_stale,
            max(data_refreshed_at_ms) as newest_refresh_ms,
            list(table_name order by pos) filter (not is_fresh) as stale,
            list(table_name order by pos) filter (met_without_row_changes) as no_change
          from status group by all) s on s.entity_name = t.entity_name and s.src_group = t.grp""",
    "gate": """
        select entity_type, entity_name, count(*) as n_groups, count(*) filter (verdict <> 'FRESH') as n_failed,
          cast(sum(len(no_change)) as bigint) as n_no_change, max(newest_refresh_ms) as newest_refresh_ms
        from verdicts group by all""",
    "named": """
        select 'JOB' as entity_type, name as entity_name, cast(job_id as string) as entity_id from jobs
        union all select 'PIPELINE', name, pipeline_id from pipelines""",
    "resolved": """
        select e.entity_type, e.entity_name, case when count(n.entity_id) = 1 then min(n.entity_id) end as entity_id,
          count(n.entity_id) as n_found,
          case when count(n.entity_id) <> 1 then 'expected exactly 1 ' || e.entity_type || ' named ''' || e.entity_name
            || ''', found ' || count(n.entity_id) end as error
        from (select distinct entity_type, entity_name from tracker) e
          left join named n on n.entity_type = e.entity_type and n.entity_name = e.entity_name
        group by e.entity_type, e.entity_name""",
    "states": """
        select 'JOB' as entity_type, cast(job_id as string) as entity_id,
          bool_or(life_cycle_state not in ('TERMINATED', 'SKIPPED', 'INTERNAL_ERROR')) as active,
          max(start_ms) as latest_start_ms, cast(arg_max(run_id, row(start_ms, run_id)) as string) as latest_id
        from job_runs group by job_id
        union all
        select 'PIPELINE', p.pipeline_id, any_value(p.state) in ('RUNNING', 'STARTING', 'DEPLOYING', 'RESETTING'),
          max(u.creation_ms), arg_max(u.update_id, row(u.creation_ms, u.update_id))
        from pipelines p left join pipeline_updates u on u.pipeline_id = p.pipeline_id group by p.pipeline_id""",
    "previous": """
        select 'JOB' as entity_type, cast(job_id as string) as entity_id, start_ms as prev_start_ms,
          cast(run_id as string) as prev_id, coalesce(result_state, life_cycle_state) as prev_state
        from (select *, row_number() over (partition by job_id order by start_ms desc, run_id desc) as n from job_runs
          where result_state = 'SUCCESS' or (result_state is null and life_cycle_state in
            ('PENDING', 'QUEUED', 'RUNNING', 'BLOCKED', 'WAITING_FOR_RETRY', 'TERMINATING'))) where n = 1
        union all
        select 'PIPELINE', pipeline_id, creation_ms, update_id, state
        from (select *, row_number() over (partition by pipeline_id order by creation_ms desc, update_id desc) as n
              from pipeline_updates where state not in ('FAILED', 'CANCELED')) where n = 1""",
    "known_entities": """
        select entity_type, entity_name, min(entity_id) as entity_id, count(*) as n_found from named group by all""",
    "entity_pipes": """
        select distinct entity_type, entity_name, entity_id as pipeline_id from known_entities
        where n_found = 1 and entity_type = 'PIPELINE'
        union
        select distinct k.entity_type, k.entity_name, j.pipeline_id from known_entities k
        join job_pipelines j on cast(j.job_id as string) = k.entity_id and j.pipeline_id is not null
        where k.n_found = 1 and k.entity_type = 'JOB'""",
    "targets": """
        select c.entity_type, c.entity_name, c.table_name, case when exists (
            select 1 from entity_pipes o where o.entity_type = c.entity_type and o.entity_name = c.entity_name
              and o.pipeline_id = m.pipeline_id) then 'OWNED' else 'IGNORED' end as status,
          case when m.table_name is null then 'NotFound' else 'pipeline_id=' || coalesce(m.pipeline_id, 'None') end as why
        from (select distinct e.entity_type, e.entity_name, l.target_table_full_name as table_name
              from entity_pipes e join table_lineage l on l.entity_type = 'PIPELINE' and l.entity_id = e.pipeline_id) c
          left join table_meta m on m.table_name = c.table_name""",
    "owned": "select entity_type, entity_name, table_name from targets where status = 'OWNED'",
    "entity_writes": """
        select o.entity_type, o.entity_name, l.target_table_full_name as target, l.source_table_full_name as source,
          l.entity_run_id, l.ts_ms
        from owned o join table_lineage l on l.target_table_full_name = o.table_name and l.entity_type = 'PIPELINE'
          join entity_pipes e on e.entity_type = o.entity_type and e.entity_name = o.entity_name and e.pipeline_id = l.entity_id
        where l.entity_run_id is not null""",
    "edges": """
        select distinct w.entity_type, w.entity_name, w.target, w.source from entity_writes w
        join (select entity_type, entity_name, target, arg_max(entity_run_id, row(ts_ms, entity_run_id)) as entity_run_id
              from entity_writes group by all) l using (entity_type, entity_name, target, entity_run_id)
        where w.source is not null and w.source <> w.target""",
    "finals": """
        select o.* from owned o where not exists (select 1 from edges e where e.entity_type = o.entity_type
          and e.entity_name = o.entity_name and e.source = o.table_name)""",
    "inputs": """
        select distinct e.entity_type, e.entity_name, e.source as table_name from edges e where not exists (
          select 1 from owned o where o.entity_type = e.entity_type and o.entity_name = e.entity_name
          and o.table_name = e.source)""",
    "views": "select table_name from table_meta where table_type in ('VIEW', 'METRIC_VIEW')",
    "walk": """
        select table_name as root, table_name as name, 0 as depth from table_meta
        union all
        select w.root, d.dep, w.depth + 1 from walk w join views v on v.table_name = w.name
          join view_deps d on d.view_name = w.name""",
    "reached": "select root, name, min(depth) as depth from walk group by all",
    "expanded": """
        select r.root, r.name from reached r join table_meta m on m.table_name = r.name
        where m.table_type not in ('VIEW', 'METRIC_VIEW')""",
    "sources": """
        select distinct i.entity_type, i.entity_name, x.name as table_name from inputs i
        join expanded x on x.root = i.table_name where not exists (select 1 from owned o
          where o.entity_type = i.entity_type and o.entity_name = i.entity_name and o.table_name = x.name)""",
    "writers": """
        select target_table_full_name as table_name, arg_max(entity_id, row(ts_ms, entity_id)) as job_id
        from table_lineage where entity_type = 'JOB' group by 1""",
    "produced": """
        select t.table_name, case when m.pipeline_id is not null then 'PIPELINE' when w.job_id is not null then 'JOB'
            else 'NONE' end as producer_type, coalesce(m.pipeline_id, w.job_id) as producer_id
        from (select table_name from table_meta union select source_table_full_name from table_lineage
              union select target_table_full_name from table_lineage) t
          left join table_meta m on m.table_name = t.table_name left join writers w on w.table_name = t.table_name""",
    "incoming": """
        select k.entity_name, k.entity_type, 'default' as src_group,
          coalesce(f.target_tables, []) as target_tables, coalesce(s.src_tables, []) as src_tables,
          coalesce(s.producers, []) as producers,
          case when k.n_found <> 1 then 'expected exactly 1 ' || k.entity_type || ' named ''' || k.entity_name
              || ''', found ' || k.n_found
            when not exists (select 1 from entity_pipes e where e.entity_type = k.entity_type and e.entity_name = k.entity_name)
              then k.entity_type || ' ''' || k.entity_name || ''' has no pipeline tasks — nothing to track.'
            when not exists (select 1 from owned o where o.entity_type = k.entity_type and o.entity_name = k.entity_name)
              then 'No tables currently managed by the pipelines of ' || k.entity_type || ' ''' || k.entity_name || ''''
            when f.target_tables is null
              then 'No final tables found — every owned table is read by another owned table (cycle?).'
            else '' end as error
        from known_entities k
          left join (select entity_type, entity_name, list(table_name) as target_tables from finals group by all) f
            on f.entity_type = k.entity_type and f.entity_name = k.entity_name
          left join (select s.entity_type, s.entity_name, list(s.table_name) as src_tables,
              list(s.table_name || '=' || concat_ws(':', p.producer_type, p.producer_id)) as producers
            from sources s join produced p on p.table_name = s.table_name group by all) s
            on s.entity_type = k.entity_type and s.entity_name = k.entity_name""",
    "tracker_flat": """
        select t.entity_name, t.entity_type, t.src_group, t.target_tables, t.src_tables, t.src_tables_to_skip,
          t.refresh_window_btn_tables_in_mins as window_mins,
          coalesce((select list(p.src_table || '=' || p.producer_type || ':' || p.producer_id) from tracker_producers p
            where p.entity_name = t.entity_name), []) as producers,
          cast(regexp_extract(t.entity_name, '([0-9]+)$', 1) as bigint) as n
        from tracker t""",
    "edited": """
        select entity_name || case when n % 7 = 0 then '_v2' else '' end as entity_name, entity_type, src_group,
          case when n % 3 = 0 then list_append(target_tables, 'main.gold.export' || n) else target_tables end as target_tables,
          case when n % 3 = 0 and src_group = 'daily' then list_append(src_tables, 'main.raw.feed' || n)
            else src_tables end as src_tables,
          case when n % 3 = 0 then list_distinct(list_append(coalesce(src_tables_to_skip, []), 'main.demo.t100'))
            else src_tables_to_skip end as src_tables_to_skip,
          case when n % 3 = 0 and src_group = 'daily' then list_append(producers, 'main.raw.feed' || n || '=JOB:78')
            else producers end as producers,
          case when n % 5 = 0 and src_group = 'daily' then 90 else window_mins end as window_mins,
          (n % 3 = 0 or n % 7 = 0 or (n % 5 = 0 and src_group = 'daily')) as changed, n
        from tracker_flat""",
    "checked_rows": """
        select entity_name, entity_type, coalesce(nullif(src_group, ''), 'default') as src_group, src_tables,
          coalesce(src_tables_to_skip, []) as skips, window_mins from edited
        union all
        select entity_name, entity_type, src_group, src_tables, coalesce(src_tables_to_skip, []), window_mins
        from tracker_flat where n % 10 = 1 and src_group = 'daily'""",
    "entity_reads": """
        select distinct entity_type || ':' || entity_name as entity, table_name from tracker_sources""",
    "entity_targets": """
        select distinct entity_type || ':' || entity_name as upstream, unnest(target_tables) as table_name from tracker""",
    "dependencies": """
        select r.entity, w.upstream, r.table_name from entity_reads r
        join entity_targets w on w.table_name = r.table_name and w.upstream <> r.entity""",
    "paths": """
        select distinct entity_type || ':' || entity_name as entity, 0 as level from tracker
        union all
        select d.entity, p.level + 1 from paths p join (select distinct entity, upstream from dependencies) d
          on d.upstream = p.entity""",
    "streaks": """
        select entity_name, result, ts_ms,
          row_number() over (partition by entity_name order by ts_ms, tick_id)
          - row_number() over (partition by entity_name, result order by ts_ms, tick_id) as streak from check_ticks""",
    "gaps": f"""
        select table_name, ts_ms - lag(ts_ms) over (partition by table_name order by ts_ms, version) as gap_ms
        from table_history where operation in ({WRITES})""",
    "params": """
        select job_id, parameters, list_filter(parameters, lambda p: starts_with(p, '--src_tables='))[-1] as tables,
          parameters[list_position(parameters, '--entity_type') + 1] as covers,
          list_filter(parameters, lambda p: starts_with(p, '--dry_run='))[-1] as dry from launch_tasks""",
}

# the launch plan: levels are unrolled, each entity after those it waits for; a graph with more of them is an error
LAUNCH_LEVELS = "abcdefghijklmn"
UNCOVERED = """
        select f.key, f.src_group, f.pipeline_id, f.update_id, min(f.table_name) as table_name,
          arg_min(f.hands_off, f.table_name) as hands_off, arg_min(f.job_id, f.table_name) as job_id
        from row_producers f where not exists (select 1 from row_upstreams u join {launched} g on g.entity = u.upstream
          where u.key = f.key and u.src_group = f.src_group and u.table_name = f.table_name)
        group by f.key, f.src_group, f.pipeline_id, f.update_id"""
STEPS |= {
    "chosen_rows": """
        select *, entity_type || ':' || entity_name as key from tracker_rows_in
        where list_has_any(tables, (select list(table_name) from refreshed_tables))""",
    "verdicts_now": """
        select t.entity_name, t.entity_type, t.key, t.grp as src_group, s.newest_refresh_ms, coalesce(s.stale, []) as stale,
          coalesce(s.no_change, []) as no_change,
          case when t.refresh_window_btn_tables_in_mins is null or len(t.tables) = 0 then 'UNCHECKED'
            when s.n_stale > 0 then 'STALE' else 'FRESH' end as verdict
        from chosen_rows t left join (
          select entity_name, src_group, count(*) filter (not is_fresh) as n_stale,
            max(data_refreshed_at_ms) as newest_refresh_ms,
            list(table_name order by pos) filter (not is_fresh) as stale,
            list(table_name order by pos) filter (met_without_row_changes) as no_change
          from status_now group by all) s on s.entity_name = t.entity_name and s.src_group = t.grp""",
    "due_rows": f"""
        select v.*, r.entity_id, r.error as name_error,
          case when s.latest_start_ms >= v.newest_refresh_ms then 'SKIP' when s.active then 'QUEUE' else 'LAUNCH' end as action,
          case when s.latest_start_ms >= v.newest_refresh_ms then 'run ' || coalesce(s.latest_id, 'None') || case when s.active
              then ' (in progress)' else ' (finished)' end || ' started ' || {utc('s.latest_start_ms')}
              || ', after the newest source refresh ' || {utc('v.newest_refresh_ms')}
            when s.active then 'run ' || coalesce(s.latest_id, 'None') || ' in progress started ' || {utc('s.latest_start_ms')}
              || ', before the newest source refresh ' || {utc('v.newest_refresh_ms')} end as due
        from verdicts_now v left join resolved r on r.entity_type = v.entity_type and r.entity_name = v.entity_name
          left join states s on s.entity_type = v.entity_type and s.entity_id = r.entity_id""",
    "settled_rows": f"""
        select *, case when verdict <> 'FRESH' then 'SKIPPED' when entity_id is null then 'NOT_FOUND'
            when action = 'SKIP' then 'ALREADY_HANDLED' end as status,
          case when verdict = 'UNCHECKED' then 'refresh window is NULL or no source tables to check'
            when verdict = 'STALE' then 'stale sources: ' || {names('stale')} when entity_id is null then name_error
            when action = 'SKIP' then due end as detail,
          concat_ws('; ', due, case when len(no_change) > 0
            then 'met by producer run without row changes: ' || {names('no_change')} end) as reason
        from due_rows""",
    "running_now": """
        select m.table_name, m.pipeline_id, u.update_id, u.cause from table_meta m
        join pipelines p on p.pipeline_id = m.pipeline_id and not p.continuous
          and p.state in ('RUNNING', 'STARTING', 'DEPLOYING', 'RESETTING')
        join (select *, row_number() over (partition by pipeline_id order by creation_ms desc, update_id desc) as n
              from pipeline_updates where state not in ('COMPLETED', 'FAILED', 'CANCELED')) u
          on u.pipeline_id = m.pipeline_id and u.n = 1""",
    "pipeline_jobs": """
        select pipeline_id, cast(arg_max(job_id, row(start_ms, run_id)) as string) as job_id from active_tasks
        where life_cycle_state in ('PENDING', 'QUEUED', 'RUNNING', 'BLOCKED', 'WAITING_FOR_RETRY') group by 1""",
    "planned": "select * from settled_rows where status is null",
    "plan_sources": """
        select p.key, p.src_group, p.entity_type, c.table_name from planned p
        join (select key, grp, unnest(list_distinct(tables)) as table_name from chosen_rows) c
          on c.key = p.key and c.grp = p.src_group""",
    "plan_targets": """
        select distinct key as upstream, unnest(target_tables) as table_name from chosen_rows
        where key in (select key from planned)""",
    "plan_edges": """
        select distinct s.key as entity, t.upstream, s.table_name from plan_sources s
        join plan_targets t on t.table_name = s.table_name and t.upstream <> s.key""",
    "plan_paths": """
        select distinct key as entity, 0 as level from planned
        union all
        select d.entity, p.level + 1 from plan_paths p join (select distinct entity, upstream from plan_edges) d
          on d.upstream = p.entity""",
    "plan_levels": "select entity, cast(max(level) as integer) as level from plan_paths group by 1",
    "handoffs": """
        select distinct t.job_id, k.entity_type, t.table_name from (
          select cast(job_id as string) as job_id, covers, trim(unnest(string_split(substr(tables, 14), ','))) as table_name
          from params where not (contains(dry, '{{') or lower(substr(dry, 11)) in ('true', '1', 'yes'))) t
        join (select unnest(['JOB', 'PIPELINE']) as entity_type) k on t.covers = 'ALL' or t.covers = k.entity_type""",
    "row_upstreams": """
        select s.key, s.src_group, s.table_name, e.upstream, u.entity_type as upstream_type, u.entity_name as upstream_name,
          l.level as upstream_level, h.job_id is not null as hands_off
        from plan_sources s join plan_edges e on e.entity = s.key and e.table_name = s.table_name
          join (select distinct key, entity_type, entity_name, entity_id from planned) u on u.key = e.upstream
          join plan_levels l on l.entity = e.upstream
          left join handoffs h on u.entity_type = 'JOB' and h.job_id = u.entity_id and h.entity_type = s.entity_type
            and h.table_name = s.table_name""",
    "row_producers": """
        select s.key, s.src_group, s.table_name, r.pipeline_id, r.update_id, r.job_id, h.job_id is not null as hands_off
        from plan_sources s join (
            select n.*, case when n.cause = 'JOB_TASK' then j.job_id end as job_id
            from running_now n left join pipeline_jobs j on j.pipeline_id = n.pipeline_id) r on r.table_name = s.table_name
          left join handoffs h on h.job_id = r.job_id and h.entity_type = s.entity_type and h.table_name = s.table_name""",
    "launched_none": f"""
        select cast(null as string) as entity where case when (select max(level) from plan_levels) >= {len(LAUNCH_LEVELS)}
          then error('this statement follows {len(LAUNCH_LEVELS)} levels, and the plan has more') else false end""",
    "row_pairs": """
        select u.key, u.src_group, u.upstream, u.upstream_level, u.upstream_type, u.upstream_name,
          list_sort(list(distinct u.table_name)) as shared, bool_or(u.hands_off) as hands_off,
          bool_or(g.entity is not null) as launches
        from row_upstreams u left join launched g on g.entity = u.upstream
        group by u.key, u.src_group, u.upstream, u.upstream_level, u.upstream_type, u.upstream_name""",
    "row_steps": f"""
        select key, src_group, arg_min('sources ' || {names('shared')} || case when launches
              then ' are being refreshed by job ''' || upstream_name
                || ''' launched in this task; its launch task launches this entity'
              else ' are refreshed later by job ''' || upstream_name
                || ''' (itself waiting on its upstream); its launch task launches this entity' end,
            row(upstream_level, upstream)) filter (hands_off) as handoff,
          list(upstream_type || ' ''' || upstream_name || ''' (refreshes ' || {names('shared')} || ')'
            order by upstream_level, upstream) filter (launches and not hands_off) as waits,
          list(upstream_type || ' ''' || upstream_name || ''' (refreshes ' || {names('shared')}
              || ') is waiting on its upstream and has no launch task for this entity: launched on its current data'
            order by upstream_level, upstream) filter (not launches and not hands_off) as notes
        from row_pairs group by all""",
    "producer_steps": """
        select key, src_group, arg_min('source ' || table_name || ' is being refreshed by job ' || job_id
            || ', whose launch task launches this entity', table_name) filter (hands_off) as handoff,
          list('pipeline ' || pipeline_id || ' update ' || update_id || ' (running, refreshes ' || table_name || ')'
            order by table_name) as waits
        from (""" + UNCOVERED.format(launched="launched") + """) group by all""",
    "stepped_rows": """
        select p.*, l.level, coalesce(u.handoff, r.handoff) as handoff, coalesce(u.notes, []) as notes,
          list_concat(coalesce(u.waits, []), coalesce(r.waits, [])) as waits
        from planned p join plan_levels l on l.entity = p.key
          left join row_steps u on u.key = p.key and u.src_group = p.src_group
          left join producer_steps r on r.key = p.key and r.src_group = p.src_group""",
    "acted_rows": """
        select s.*, min(src_group) filter (handoff is null) over (partition by entity_type, entity_id) as acting
        from stepped_rows s""",
    "launch_rows": """
        select entity_name, entity_type, src_group, entity_id, cast(null as integer) as level, status, detail from settled_rows
        where status is not null
        union all
        select entity_name, entity_type, src_group, entity_id, level,
          case when handoff is not null then 'WAITING_ON_UPSTREAM' when src_group = acting then 'DRY_RUN_' || action
            else 'ALREADY_HANDLED' end,
          case when handoff is not null then handoff
            when src_group <> acting then 'covered by the run launched for src_group ''' || acting || ''''
            else 'would ' || case when len(waits) > 0 then 'wait for ' || array_to_string(waits, '; ')
                || ', re-check the sources, then ' else '' end || lower(action) || ' ' || entity_type || ' id=' || entity_id
              || case when reason = '' and len(notes) = 0 then ''
                else ' (' || concat_ws('; ', nullif(reason, ''), nullif(array_to_string(notes, '; '), '')) || ')' end end
        from acted_rows""",
}
STEPS |= {f"launched_{here}": f"""
        select entity from launched_{before}
        union all
        select distinct p.key from planned p join plan_levels l on l.entity = p.key and l.level = {level}
        where not exists (select 1 from row_upstreams u where u.hands_off and u.key = p.key and u.src_group = p.src_group)
          and not exists (select 1 from ({UNCOVERED.format(launched='launched_' + before)}) x
            where x.hands_off and x.key = p.key and x.src_group = p.src_group)"""
          for level, (before, here) in enumerate(zip(["none", *LAUNCH_LEVELS], LAUNCH_LEVELS))}
STEPS["launched"] = f"select entity from launched_{LAUNCH_LEVELS[-1]}"

STATUS = """entity_name, entity_type, src_group, table_name, window_mins, producer_type, producer_id, last_write_ms,
    operation, success_ms, signal, cutoff_ms, refreshed_at_ms, data_refreshed_at_ms, is_fresh, basis,
    met_without_row_changes"""
FAILURE = (f"case when verdict = 'UNCHECKED' then 'src_group ''' || src_group || ''': refresh window is NULL or no source "
           f"tables to check' else 'src_group ''' || src_group || ''': ' || n_stale || ' of ' || n_sources "
           f"|| ' source(s) not refreshed since ' || {utc('cutoff_ms')} || ': ' || {names('stale')} end")
AGE = "(({now} - refreshed_at_ms) / 1000.0 / 60.0)".replace("{now}", str(NOW_MS))
AGE = AGE.replace("1000.0", "cast(1000 as double)").replace("60.0", "cast(60 as double)")
BREAK = "chr(10) || '          '"

RESULTS = {
    "last_write": "select table_name, last_write_ms, operation from last_write",
    "impacted_rows": f"select table_name, {SHOWN_ROWS} as impacted_rows from last_write",
    "flow_last_completed": "select pipeline_id, dataset, done_ms, update_id from last_done",
    "update_row_counts": "select pipeline_id, dataset, update_id, output_rows, upserted_rows, deleted_rows from flow_done",
    "dataset_suffix_match": """
        select m.table_name, m.pipeline_id, d.dataset from table_meta m
        join (select distinct pipeline_id, dataset from flow_definitions) d on d.pipeline_id = m.pipeline_id
          and (d.dataset = m.table_name or ends_with(m.table_name, '.' || d.dataset))""",
    "events_last_completed": """
        select m.table_name, e.done_ms from events_done e join table_meta m on m.table_id = e.uc_table_id""",
    "job_last_success": "select job_id, done_ms, run_id from job_done",
    "pipeline_last_success": "select table_name, pipeline_id, success_ms, signal from pipeline_done",
    "update_covering_table": "select table_name, pipeline_id, start_ms, update_id from covering",
    "resolve_producer": "select entity_name, src_group, table_name, producer_type, producer_id from status",
    "source_status": f"select {STATUS} from status",
    "source_status_text": f"""
        select entity_name, src_group, table_name, concat_ws({BREAK},
          case when is_fresh then 'MET (' || basis || ')' else 'NOT MET' end || ' ' || table_name || ': refreshed '
            || case when refreshed_at_ms is null then 'never' when {AGE} < 120 then printf('%.1f', {AGE}) || ' min ago'
                 when {AGE} < 2880 then printf('%.1f', {AGE} / 60) || ' h ago'
                 else printf('%.1f', {AGE} / 1440) || ' days ago' end || ' — '
            || case when refreshed_at_ms is null then '' else 'refreshed_at ' || {utc('refreshed_at_ms')}
                 || case when is_fresh then ' >= ' else ' < ' end end || 'cutoff ' || {utc('cutoff_ms')}
            || ' (now ' || {utc(str(NOW_MS))} || ' − window ' || window_mins || ' min)',
          case when last_write_ms is not null then 'last write: ' || operation || ' at ' || {utc('last_write_ms')}
                 || ' (' || {SHOWN_ROWS} || ')'
            when operation = 'MATERIALIZED_VIEW'
              then 'last write: materialized view — no Delta history; refresh and rows from its producer pipeline'
            else 'last write: none found' end,
          'producer: ' || concat_ws(' ', producer_type, producer_id)
            || case when success_ms is null then coalesce(' — ' || signal, '')
                 when operation = 'MATERIALIZED_VIEW' then ' refreshed it at ' || {utc('success_ms')} || ' [' || signal || ']'
                 when success_ms >= cutoff_ms and (last_write_ms is null or last_write_ms < cutoff_ms)
                   then ' ran successfully at ' || {utc('success_ms')} || ' [' || signal
                     || '] — no write within the window (run changed no rows)'
                 else ' last success ' || {utc('success_ms')} || ' [' || signal || ']' end) as description
        from status""",
    "refreshed_now_status": f"select {STATUS} from status_now",
    "group_verdict": """
        select entity_name, entity_type, src_group, window_mins, n_sources, n_stale, cutoff_ms, newest_refresh_ms,
          array_to_string(stale, ',') as stale, array_to_string(no_change, ',') as no_change, verdict from verdicts""",
    "entity_gate": """
        select *, case when n_failed > 0 then 'FAILED' else 'PASSED' end as verdict,
          'Freshness check ' || case when n_failed > 0 then 'FAILED' else 'PASSED' end || ' for ' || entity_type || ' '''
            || entity_name || ''':' || case when n_failed > 0 then '' else ' all ' || n_groups || ' source group(s) fresh.' end
            as headline from gate""",
    "gate_lines": f"""
        select entity_type, entity_name, src_group, 'failure' as kind, {FAILURE} as line from verdicts where verdict <> 'FRESH'
        union all
        select entity_type, entity_name, src_group, 'met by producer run without row changes', t || ' [' || src_group || ']'
        from (select *, unnest(no_change) as t from verdicts)""",
    "stale_report": """
        select entity_name, entity_type, src_group, n_stale, n_sources, cutoff_ms, unnest(stale) as table_name
        from verdicts where verdict = 'STALE'""",
    "already_processed": f"""
        select g.entity_type, g.entity_name, r.entity_id, g.newest_refresh_ms, p.prev_start_ms, p.prev_id, p.prev_state,
          case when r.entity_id is null then 'ERROR' when p.prev_start_ms >= g.newest_refresh_ms then 'ALREADY_PROCESSED'
            else 'RUN' end as verdict,
          case when r.entity_id is null then r.error
            when p.prev_start_ms is null then 'No previous successful run of ' || g.entity_type || ' ''' || g.entity_name
              || ''': not processed yet.'
            when p.prev_start_ms >= g.newest_refresh_ms then 'Already processed: previous successful run ' || p.prev_id
              || ' (' || p.prev_state || ') of ' || g.entity_type || ' ''' || g.entity_name || ''' started '
              || {utc('p.prev_start_ms')} || ', after the newest source refresh ' || {utc('g.newest_refresh_ms')} || '.'
            else 'Not processed yet: previous successful run ' || p.prev_id || ' started ' || {utc('p.prev_start_ms')}
              || ', before the newest source refresh ' || {utc('g.newest_refresh_ms')} || '.' end as detail
        from gate g left join resolved r on r.entity_type = g.entity_type and r.entity_name = g.entity_name
          left join previous p on p.entity_type = g.entity_type and p.entity_id = r.entity_id where g.n_failed = 0""",
    "previous_runs": "select * from previous",
    "candidates": f"""
        select entity_name, entity_type, src_group, {csv('src_tables')} as src_tables from tracker_rows_in
        where list_has_any(tables, (select list(table_name) from refreshed_tables))""",
    "run_state": "select * from states",
    "decide": f"""
        select v.entity_name, v.entity_type, v.src_group, r.entity_id, v.newest_refresh_ms,
          case when s.latest_start_ms >= v.newest_refresh_ms then 'SKIP' when s.active then 'QUEUE' else 'LAUNCH' end as action,
          case when s.latest_start_ms >= v.newest_refresh_ms then 'run ' || s.latest_id || case when s.active
              then ' (in progress)' else ' (finished)' end || ' started ' || {utc('s.latest_start_ms')}
              || ', after the newest source refresh ' || {utc('v.newest_refresh_ms')}
            when s.active then 'run ' || coalesce(s.latest_id, 'None') || ' in progress started ' || {utc('s.latest_start_ms')}
              || ', before the newest source refresh ' || {utc('v.newest_refresh_ms')} else '' end as reason
        from verdicts v join resolved r on r.entity_type = v.entity_type and r.entity_name = v.entity_name
          left join states s on s.entity_type = v.entity_type and s.entity_id = r.entity_id
        where v.verdict = 'FRESH' and r.entity_id is not null""",
    "resolve_name": "select * from resolved",
    "name_matches": """
        select n.* from named n where exists (select 1 from tracker t where t.entity_type = n.entity_type
          and t.entity_name = n.entity_name)""",
    "owned_tables": """
        select entity_type, entity_name, table_name, status, case when status = 'IGNORED' then why end as reason from targets""",
    "target_counts": """
        select status, case when status = 'IGNORED' then why else '' end as reason, count(*) as n_tables from targets group by all""",
    "latest_write_edges": "select * from edges",
    "final_targets": "select * from finals",
    "external_inputs": "select * from inputs",
    "view_expansion": "select x.root, x.name from expanded x join views v on v.table_name = x.root",
    "missing_and_unresolved": """
        select root, name, kind from (
          select r.root, case when m.n % 13 = 4 then r.name || ' (no access)' else r.name end as name,
            case when m.name is null or m.n % 13 = 4 then 'MISSING' when m.is_view and r.depth >= 2 then 'UNRESOLVED' end as kind
          from (select root, name, min(depth) as depth from seen group by all) r
            left join known m on m.name = r.name) where kind is not null""",
    "unfollowed_sources": """
        select distinct i.entity_type, i.entity_name, case when k.n % 13 = 4 then w.name || ' (no access)' else w.name end as name,
          'MISSING' as kind
        from inputs i join input_walk w on w.root = i.table_name left join known k on k.name = w.name
        where k.name is null or k.n % 13 = 4""",
    "source_producers": """
        select * from produced where table_name in (select source_table_full_name from table_lineage
          union select target_table_full_name from table_lineage)""",
    "tracker_rows": f"""
        select entity_name, entity_type, src_group, {csv('target_tables')} as target_tables, {csv('src_tables')} as src_tables,
          {csv('producers')} as producers, error from incoming""",
    "tracker_upsert": f"""
        select coalesce(t.entity_name, i.entity_name) as entity_name, coalesce(t.entity_type, i.entity_type) as entity_type,
          case when t.entity_name is not null then coalesce(t.src_group, '') else i.src_group end as src_group,
          {csv('case when i.entity_name is not null then i.target_tables else t.target_tables end')} as target_tables,
          {csv('case when i.entity_name is not null then i.src_tables else t.src_tables end')} as src_tables,
          coalesce({csv('t.src_tables_to_skip')}, '') as src_tables_to_skip,
          {csv('case when i.entity_name is not null then i.producers else t.producers end')} as producers,
          case when t.entity_name is not null then t.window_mins else 5 end as window_mins,
          case when t.entity_name is not null then '2024-01-01' else '2024-01-31' end as created_on,
          case when i.entity_name is not null then '2024-01-31' else '2024-01-01' end as updated_on,
          case when t.entity_name is not null then 'setup' else 'tester' end as created_by,
          case when i.entity_name is not null then 'tester' else 'setup' end as updated_by
        from tracker_flat t full join (select * from incoming where error = '') i on i.entity_name = t.entity_name
          and i.entity_type = t.entity_type and i.src_group = coalesce(t.src_group, 'default')""",
    "tracker_edits": f"""
        select entity_name, entity_type, coalesce(src_group, '') as src_group, {csv('target_tables')} as target_tables,
          {csv('src_tables')} as src_tables, coalesce({csv('src_tables_to_skip')}, '') as src_tables_to_skip,
          {csv('producers')} as producers, window_mins, '2024-01-01' as created_on,
          case when changed then '2024-01-31' else '2024-01-01' end as updated_on, 'setup' as created_by,
          case when changed then 'tester' else 'setup' end as updated_by from edited""",
    "tracker_validate": """
        select entity_name, entity_type, src_group, 'duplicate key' as issue, cast(count(*) as string) as detail
        from checked_rows group by 1, 2, 3 having count(*) > 1
        union all
        select entity_name, entity_type, src_group, 'skipped table not in src_tables', t from (
          select *, unnest(list_filter(list_distinct(skips), lambda s: not list_contains(src_tables, s))) as t from checked_rows)
        union all
        select entity_name, entity_type, src_group, 'window is NULL', '' from checked_rows where window_mins is null
        union all
        select entity_name, entity_type, src_group, 'no source tables to check', '' from checked_rows
        where len(list_filter(src_tables, lambda s: not list_contains(skips, s))) = 0""",
    "entity_edges": """
        select entity, upstream, array_to_string(list_sort(list(distinct table_name)), ',') as tables
        from dependencies group by all""",
    "running_producers": "select * from running_now",
    "launch_task_params": f"""
        select job_id, {csv("list_transform(string_split(substr(tables, 14), ','), lambda t: trim(t))")} as tables,
          covers, contains(dry, '{{{{') or lower(substr(dry, 11)) in ('true', '1', 'yes') as dry_run from params""",
    "jobs_running_pipelines": "select * from pipeline_jobs",
    "upstream_levels": "select entity, cast(max(level) as integer) as level from paths group by 1",
    "launch_plan": """
        select *, rpad(status, cast(greatest(19, len(status)) as integer), ' ') || ' ' || rpad(entity_type, cast(greatest(8, len(entity_type)) as integer), ' ')
          || ' ' || entity_name || ' [' || src_group || ']: ' || detail as line,
          row_number() over (order by level nulls last, entity_type, entity_name, src_group) as position from launch_rows""",
    "plan_summary": """
        select status, count(*) as n_rows, status in ('FAILED', 'NOT_FOUND') as fails from launch_rows group by 1""",
    "recheck": f"""
        select v.entity_name, v.entity_type, v.src_group,
          case when v.verdict <> 'FRESH' then 'SKIPPED' when r.entity_id is null then 'NOT_FOUND'
            when s.latest_start_ms >= v.newest_refresh_ms then 'ALREADY_HANDLED' when s.active then 'DRY_RUN_QUEUE'
            else 'DRY_RUN_LAUNCH' end as status,
          case when v.verdict = 'UNCHECKED' then 'refresh window is NULL or no source tables to check'
            when v.verdict = 'STALE' then 'stale sources after waiting for the upstream runs: ' || {names('v.stale')}
            when r.entity_id is null then r.error
            when s.latest_start_ms >= v.newest_refresh_ms then 'run ' || s.latest_id || case when s.active
              then ' (in progress)' else ' (finished)' end || ' started ' || {utc('s.latest_start_ms')}
              || ', after the newest source refresh ' || {utc('v.newest_refresh_ms')} end as detail
        from verdicts v left join resolved r on r.entity_type = v.entity_type and r.entity_name = v.entity_name
          left join states s on s.entity_type = v.entity_type and s.entity_id = r.entity_id""",
    "gate_of_requested": """
        select n.entity_type, n.entity_name, g.n_groups,
          case when g.n_groups is null then 'ERROR' when g.n_failed > 0 then 'FAILED' else 'PASSED' end as verdict
        from (select distinct entity_type, entity_name from named) n
          left join gate g on g.entity_type = n.entity_type and g.entity_name = n.entity_name""",
    "previous_runs_of_others": """
        select 'JOB' as entity_type, cast(job_id as string) as entity_id, start_ms as prev_start_ms,
          cast(run_id as string) as prev_id, result_state as prev_state
        from (select *, row_number() over (partition by job_id order by start_ms desc, run_id desc) as n from job_runs
          where result_state = 'SUCCESS' and life_cycle_state <> 'RUNNING') where n = 1
        union all
        select * from previous where entity_type = 'PIPELINE'""",
    "select_rows": "select entity_name, entity_type from tracker where entity_type = 'PIPELINE' and src_group is null",
    "status_with_few_signals": f"""
        select {STATUS}, case when {UNREADABLE.format('table_name')} and table_name in (select table_name from table_meta
          where table_type <> 'MATERIALIZED_VIEW') then 'no access to history' else '' end as error from status_few""",
    "consecutive_failures": """
        select entity_name, count(*) as n_failed, min(ts_ms) as first_ms, max(ts_ms) as last_ms
        from streaks where result <> 'SUCCESS' group by entity_name, streak having count(*) >= 4""",
    "no_success_for": f"""
        select entity_name, max(ts_ms) filter (result = 'SUCCESS') as last_success_ms, count(*) as n_ticks from check_ticks
        group by 1 having last_success_ms is null or last_success_ms < {NOW_MS} - 1 * 3600000""",
    "refresh_gaps": """
        select s.entity_name, s.entity_type, s.src_group, s.table_name, s.window_mins, g.n_gaps, g.median_gap_ms, g.max_gap_ms,
          s.window_mins * 60000 < g.median_gap_ms as window_below_median, s.window_mins * 60000 < g.max_gap_ms as window_below_max
        from (select distinct entity_name, entity_type, src_group, table_name, cast(window_mins as integer) as window_mins
              from tracker_sources where window_mins is not null) s
        join (select table_name, count(*) as n_gaps, max(gap_ms) as max_gap_ms, quantile_disc(gap_ms, 0.5) as median_gap_ms
              from gaps where gap_ms is not null group by 1) g on g.table_name = s.table_name""",
    "stream_refresh_state": f"""
        select table_name, last_write_ms, operation, {SHOWN_ROWS} as impacted_rows from last_write""",
}
RESULTS["fresh_intervals"] = """
        select distinct entity_name, entity_type, src_group, from_ms, until_ms from (
          select s.entity_name, r.entity_type, s.src_group, s.t as from_ms,
            min(u.t) as until_ms from span_states s
          join tracker_rows_in r on r.entity_name = s.entity_name and r.grp = s.src_group
          join span_states u on u.entity_name = s.entity_name and u.src_group = s.src_group and u.t > s.t and not u.fresh
          where s.fresh and not s.was group by all)"""
RESULTS["gate_as_of"] = "select now_ms, entity_name, entity_type, src_group, verdict from span_verdicts"
RESULTS["stored_lineage_edges"] = RESULTS["latest_write_edges"]
RESULTS["stored_update_rows"] = RESULTS["update_row_counts"]
RESULTS["tracker_upsert_slots"] = RESULTS["tracker_upsert"]
RESULTS["stream_flow_state"] = RESULTS["update_row_counts"]
RESULTS["dependency_cycles"] = """
        select coalesce(m.entity, g.entity) as entity, m.cycle, m.n_members, coalesce(g.given_up, '') as given_up
        from (select *, count(*) over (partition by cycle) as n_members from loop_members) m
        full join (select entity, array_to_string(list_sort(list(upstream)), ',') as given_up from loop_given_up group by 1) g
          on g.entity = m.entity"""
RESULTS["impact_closure"] = "select table_name, entity, cast(min(d) as integer) as distance from impact_walk group by all"
STEPS |= {
    "loop_edges": """
        select distinct l.entity, l.upstream from loops l join supplier a on 'E' || a.s_suppkey = l.entity
        join supplier b on 'E' || b.s_suppkey = l.upstream where l.entity <> l.upstream""",
    "loop_reach": """
        select entity as a, upstream as b from loop_edges
        union select r.a, e.upstream from loop_reach r join loop_edges e on e.entity = r.b""",
    "loop_members": """
        select r.a as entity, min(r.b) as cycle from loop_reach r join loop_reach q on q.a = r.b and q.b = r.a group by 1""",
    # walks upstream that stay at v or after it
    "loop_above": """
        select 'E' || v.s_suppkey as v, e.entity as a, e.upstream as b from supplier v
        join loop_edges e on e.entity >= 'E' || v.s_suppkey and e.upstream >= 'E' || v.s_suppkey
        union select w.v, w.a, e.upstream from loop_above w join loop_edges e on e.entity = w.b and e.upstream >= w.v""",
    "loop_points": """
        select w.a as entity, max(w.v) as point from loop_above w join loop_above c on c.v = w.v and c.a = w.b and c.b = w.b
        group by 1""",
    "loop_given_up": """
        select e.entity, e.upstream from loop_edges e join loop_points p on p.entity = e.entity and p.point = p.entity
        join loop_points u on u.entity = e.upstream and u.point >= e.entity""",
    # distances up to 60
    "impact_walk": """
        select distinct t.table_name, l.entity, 1 as d from refreshed_tables t
        join loops l on 'main.demo.t' || substr(l.upstream, 2) = t.table_name
        union select w.table_name, l.entity, w.d + 1 from impact_walk w join loops l on l.upstream = w.entity where w.d < 60""",
}
TICK_TIMES = ", ".join(str(FIRST_MS + h * 3_600_000) for h in (48, 60, 72, 240, 480, 720))
RESULTS["gate_ticks"] = """
        select now_ms, entity_name, entity_type, src_group, n_sources, verdict, n_stale, stale_at_ms from (
          select *, lag(verdict) over w as was, lag(n_stale) over w as n_was from tick_verdicts
          window w as (partition by entity_name, src_group order by now_ms))
        where was is null or verdict <> was or n_stale <> n_was"""
STEPS |= {
    "tick_times": f"select unnest([{TICK_TIMES}])::bigint as now_ms",
    "tick_writes": f"""
        select t.now_ms, h.table_name, max(h.ts_ms) as ms from tick_times t join table_history h on h.ts_ms <= t.now_ms
        where h.operation in ({WRITES}) group by all""",
    "tick_events": """
        select t.now_ms, e.uc_table_id, max(e.ts_ms) as ms from tick_times t join pipeline_events e on e.ts_ms <= t.now_ms
        where e.status = 'COMPLETED' group by all""",
    "tick_jobs": """
        select t.now_ms, cast(r.job_id as string) as job_id, arg_max(r.end_ms, row(r.start_ms, r.run_id)) as ms
        from tick_times t join job_runs r on r.end_ms <= t.now_ms
        where r.life_cycle_state = 'TERMINATED' and r.result_state = 'SUCCESS' group by all""",
    "tick_sources": """
        select t.now_ms, s.entity_name, s.src_group, cast(s.window_mins as bigint) * 60000 as window_ms,
          greatest(case when m.table_type = 'MATERIALIZED_VIEW' then null else w.ms end,
            case when m.pipeline_id is not null then e.ms else j.ms end) as ms
        from tick_times t cross join tracker_sources s left join table_meta m on m.table_name = s.table_name
          left join tick_writes w on w.now_ms = t.now_ms and w.table_name = s.table_name
          left join tick_events e on e.now_ms = t.now_ms and e.uc_table_id = m.table_id
          left join tracker_producers p on p.entity_name = s.entity_name and p.src_table = s.table_name
          left join tick_jobs j on j.now_ms = t.now_ms and j.job_id = p.producer_id
        where s.window_mins is not null""",
    "tick_verdicts": """
        select t.now_ms, r.entity_name, r.entity_type, r.grp as src_group, cast(len(r.tables) as bigint) as n_sources,
          case when r.refresh_window_btn_tables_in_mins is null or len(r.tables) = 0 then 'UNCHECKED'
            when s.n_stale > 0 then 'STALE' else 'FRESH' end as verdict, coalesce(s.n_stale, 0) as n_stale, s.stale_at_ms
        from tick_times t cross join tracker_rows_in r left join (
          select now_ms, entity_name, src_group, count(*) filter (ms is null or ms < now_ms - window_ms) as n_stale,
            min(ms + window_ms + 1) filter (ms >= now_ms - window_ms) as stale_at_ms
          from tick_sources group by all) s on s.now_ms = t.now_ms and s.entity_name = r.entity_name and s.src_group = r.grp""",
    "known": """
        select table_name as name, table_type in ('VIEW', 'METRIC_VIEW') as is_view,
          cast(regexp_extract(table_name, '([0-9]+)$', 1) as bigint) as n
        from table_meta where cast(regexp_extract(table_name, '([0-9]+)$', 1) as bigint) % 11 <> 3""",
    "input_walk": """
        select distinct table_name as root, table_name as name from inputs
        union
        select w.root, d.dep from input_walk w join known k on k.name = w.name and k.is_view and k.n % 13 <> 4
          join view_deps d on d.view_name = w.name""",
    "seen": """
        select table_name as root, table_name as name, 0 as depth from table_meta
        union all
        select w.root, d.dep, w.depth + 1 from seen w join known k on k.name = w.name and k.is_view and k.n % 13 <> 4
          join view_deps d on d.view_name = w.name where w.depth < 2""",
}


STEPS |= {
    "span_sources": STEPS["tick_sources"].replace("else j.ms end", "end"),
    "span_verdicts": STEPS["tick_verdicts"].replace("tick_sources", "span_sources"),
    "span_events": f"""
        select s.entity_name, s.src_group, s.pos, cast(s.window_mins as bigint) * 60000 as window_ms, x.ms
        from tracker_sources s left join table_meta m on m.table_name = s.table_name
        join (select 'w' as kind, table_name as name, ts_ms as ms from table_history where operation in ({WRITES})
              union all select 'c', uc_table_id, ts_ms from pipeline_events where status = 'COMPLETED') x
          on (x.kind = 'w' and x.name = s.table_name and coalesce(m.table_type, '') <> 'MATERIALIZED_VIEW')
          or (x.kind = 'c' and x.name = m.table_id and m.pipeline_id is not null)
        where s.window_mins is not null""",
    # a group's state can only change when a source is refreshed or runs out of its window
    "span_instants": """
        select entity_name, src_group, ms as t from span_events
        union select entity_name, src_group, ms + window_ms + 1 from span_events""",
    "span_counts": """
        select i.entity_name, i.src_group, i.t, count(distinct e.pos) as n from span_instants i
        left join span_events e on e.entity_name = i.entity_name and e.src_group = i.src_group
          and e.ms <= i.t and e.ms >= i.t - e.window_ms group by all""",
    "span_states": """
        select *, lag(fresh, 1, false) over (partition by entity_name, src_group order by t) as was from (
          select c.entity_name, c.src_group, c.t, c.n = len(r.tables) as fresh from span_counts c
          join tracker_rows_in r on r.entity_name = c.entity_name and r.grp = c.src_group)""",
}


def _needed(sql: str, found: dict[str, str]) -> None:
    for word in dict.fromkeys(re.findall(r"\b(?:from|join)\s+([a-z_]+)", sql)):
        text = STEPS.get(word) or (duckdb_view(word) if word in TEMPLATES else None)
        if text is not None and word not in found:
            found[word] = ""  # reserve, so that a recursive step does not look for itself
            _needed(text, found)
            found.pop(word)
            found[word] = text


def statements() -> dict[str, str]:
    out = {}
    for name, result in RESULTS.items():
        steps: dict[str, str] = {}
        _needed(result, steps)
        views = ",\n".join(f"{step} AS ({text})" for step, text in steps.items())
        out[name] = f"WITH RECURSIVE {views}\n{result}"
    return out
