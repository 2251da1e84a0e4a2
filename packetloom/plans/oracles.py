"""DuckDB SQL for :mod:`packetloom.plans.relational`."""

EV = "ev as (select event_id, epoch_us(ts) as us, user_id, event_type, value from events)"
PK = EV + """,
pk0 as (select event_id, (256 + user_id % 8)::int as pid, event_type,
  sum(case when event_id % 97 = 0 then 2 else 1 end) over (partition by user_id % 8 order by event_id) as n from ev),
pk as (select event_id, pid, event_type = 'error' as tei, event_type = 'signup' as pusi, false as priority, 0 as scrambling,
  case when event_type = 'purchase' then 3 else 1 end::int as afc, (n % 16)::int as cc, (event_id * 3000) % 8589934592 as pcr_base,
  71::bigint * 16777216 + (event_type = 'error')::bigint * 8388608 + (event_type = 'signup')::bigint * 4194304 + pid::bigint * 256
    + case when event_type = 'purchase' then 3 else 1 end * 16 + (n % 16)::bigint as header from pk0)"""
CC = PK + """,
c0 as (select *, sum(tei::int) over (partition by pid order by event_id) as stretch from pk),
c1 as (select *, lag(cc) over (partition by pid, stretch order by event_id) as last_cc from c0 where not tei),
c2 as (select *, case when last_cc is null or last_cc = cc then 0 else (cc - last_cc + 31) % 16 end::int as missing from c1)"""
IV = EV + """,
i0 as (select user_id, us as b, lag(us) over (partition by user_id order by event_id) as a from ev),
i1 as (select * from i0 where a is not null and b > a and b - a <= 36000000000),
i2 as (select *, unnest(range((a // 3600000000), ((b - 1) // 3600000000) + 1)) as bucket from i1),
bk as (select bucket, sum(floor(3600 * (least(b, (bucket + 1) * 3600000000) - greatest(a, bucket * 3600000000))::double / (b - a)))::bigint as packets from i2 group by bucket)"""
RG = """rg as (select o_custkey, datediff('day', date '1970-01-01', o_orderdate::date)::bigint as a,
  datediff('day', date '1970-01-01', o_orderdate::date)::bigint + o_orderkey % 90 as b from orders),
r1 as (select *, max(b) over (partition by o_custkey order by a, b rows between unbounded preceding and 1 preceding) as reach from rg),
r2 as (select *, sum((reach is null or a > reach)::int) over (partition by o_custkey order by a, b rows unbounded preceding) as run from r1),
mi as (select o_custkey, min(a) as a, max(b) as b from r2 group by o_custkey, run)"""


def upper(frame: str) -> str:
    return f"list_sort({frame})[len({frame}) // 2 + 1]"


ORACLES: dict[str, str] = {
    "header_decode": f"with {PK} select event_id, header, 71 as sync, tei, pusi, priority, pid, scrambling, afc, cc from pk",
    "pid_summary": f"""with {CC} select pid, count(*) as packets, count(*) filter (not tei) as payload_packets, count(*) filter (tei) as transport_errors,
        0::bigint as scrambled, count(*) filter (last_cc = cc) as duplicates, count(*) filter (missing > 0) as gaps
        from (select pid, tei, cc, last_cc, missing from c2 union all select pid, tei, cc, null, 0 from pk where tei) group by pid""",
    "pid_share": f"with {PK} select pid, count(*) as packets, round(count(*) * 100.0::double / (select count(*) from pk), 6) as share from pk group by pid",
    "verdict": f"""with {PK} select pid, case when count(*) < 10 then 'Incomplete' when sum(tei::int) > 0 then 'Error' when sum(pusi::int) > 0 then 'Warning' else 'Pass' end as verdict,
        sum(tei::int)::bigint as errors, sum(pusi::int)::bigint as warnings from pk group by pid""",
    "error_totals": f"""with {PK} select coalesce(pid, -1) as pid, sum(tei::int)::bigint as errors, sum(pusi::int)::bigint as warnings from pk where tei or pusi group by grouping sets ((pid), ())""",
    "continuity_gaps": f"with {CC} select event_id, pid, ((last_cc + 1) % 16)::int as expected, cc, missing from c2 where missing > 0",
    "duplicate_runs": f"""with {EV}, a as (select *, lag(event_type) over (partition by user_id order by event_id) as was from ev),
        b as (select *, sum((was is null or was <> event_type)::int) over (partition by user_id order by event_id) as run from a)
        select user_id, min(event_id) as first_id, max(event_id) as last_id, count(*) as n from b group by user_id, run having count(*) > 1""",
    "unwrap_clock": f"""with {EV}, a as (select event_id, user_id, (event_id * 4000037) % 8589934592 as raw from ev),
        b as (select *, lag(raw) over (partition by user_id order by event_id) as was from a)
        select event_id, user_id, (raw + sum(case when was - raw > 4294967296 then 8589934592 when raw - was > 4294967296 then -8589934592 else 0 end)
          over (partition by user_id order by event_id))::bigint as unwrapped from b""",
    "clock_checks": f"""with {EV}, a as (select event_id, user_id, us - lag(us) over (partition by user_id order by event_id) as delta from ev)
        select event_id, user_id, delta, case when delta < -1000 then 'Backward' when delta > 21600000000 then 'Jump' else 'Gap' end as kind from a where delta < -1000 or delta > 3600000000""",
    "reset_segments": f"""with {EV}, a as (select *, sum((event_type = 'error')::int) over (partition by user_id order by event_id)::bigint as segment from ev)
        select user_id, segment, count(*) as n, min(event_id) as first_id, max(event_id) as last_id from a group by user_id, segment""",
    "pes_units": f"""with {PK}, a as (select *, sum(case when tei then 0 else pusi::int end) over (partition by pid order by event_id) as unit from pk),
        l as (select pid, max(unit) as last_unit from a group by pid)
        select pid, min(event_id) as start_id, count(*)::bigint as n from a join l using (pid) where unit > 0 and unit < last_unit group by pid, unit having not bool_or(tei)""",
    "coalesce_events": f"""with {EV}, a as (select user_id % 8 as pid, event_type, event_id, user_id from ev where event_type in ('error', 'signup')),
        b as (select *, lag(event_id) over (partition by pid, event_type order by event_id) as was from a),
        c as (select *, sum((was is null or event_id - was > 64)::int) over (partition by pid, event_type order by event_id) as s from b)
        select pid, event_type, min(event_id) as start_id, max(event_id) as end_id, count(*) as occurrences, min_by(user_id, event_id) as user_id from c group by pid, event_type, s""",
    "event_cap": f"""with {EV} select event_id, user_id, greatest(0, (select count(*) from ev where event_type = 'error') - 500)::bigint as omitted
        from ev where event_type = 'error' order by event_id limit 500""",
    "bitrate_longest_segment": f"""with {PK}, a as (select *, lag(pcr_base) over (partition by pid order by event_id) as was from pk),
        b as (select *, sum((was is null or pcr_base - was <= 0 or pcr_base - was > 90000 or tei)::int) over (partition by pid order by event_id) as s from a),
        g as (select pid, s, max(pcr_base) - min(pcr_base) as ticks, count(*) - 1 as n, min(event_id) as start_id from b group by pid, s),
        r as (select *, row_number() over (partition by pid order by ticks desc, start_id) as k from g where ticks >= 45000)
        select pid, ticks, n, start_id, round(n * 188 * 8 * 90000.0::double / ticks, 3) as bitrate from r where k = 1""",
    "timeline_buckets": f"with {IV} select bucket, packets from bk",
    "timeline_compaction": f"""with {IV}, s as (select min(bucket) as low, greatest(0, ceil(log2((max(bucket) - min(bucket) + 1) / 64.0::double)))::int as power from bk)
        select floor((bucket - low) / pow(2.0::double, power))::bigint as slot, sum(packets)::bigint as packets from bk, s group by 1""",
    "asof_clock": f"""with {EV}, a as (select *, last_value(case when event_type = 'view' then us end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as own,
        last_value(case when event_type = 'view' then us end ignore nulls) over (partition by user_id % 8 order by event_id rows unbounded preceding) as near from ev)
        select event_id, user_id, coalesce(own, near) as clock, own is null as is_estimated from a where event_type = 'error'""",
    "nearest_anchor": f"""with {EV}, p as (select user_id, event_id as anchor from ev where event_type = 'purchase'), e as (select user_id, event_id from ev where event_type = 'error')
        select e.event_id, arg_min(p.anchor, abs(p.anchor - e.event_id) * 2 + (p.anchor > e.event_id)::int) as anchor from e left join p using (user_id) group by e.event_id""",
    "catalog_effective_join": f"""with {EV}, o as (select o_custkey as user_id, o_orderkey, max(o_orderpriority) as priority from orders group by 1, 2),
        e as (select event_id, user_id from ev where event_type = 'click')
        select e.event_id, e.user_id, o.priority as effective from e asof left join o on e.user_id = o.user_id and e.event_id > o.o_orderkey""",
    "track_mapping": """with s as (select s_suppkey, s_nationkey as n, round(s_acctbal * 100)::bigint as sb from supplier),
        c as (select c_custkey, c_nationkey as n, round(c_acctbal * 100)::bigint as cb from customer where c_mktsegment = 'BUILDING'),
        m as (select s_suppkey, c_custkey, abs(sb - cb) as distance from s join c using (n) where abs(sb - cb) <= 50000),
        b as (select *, row_number() over (partition by s_suppkey order by distance, c_custkey) as k, count(*) over (partition by s_suppkey) as candidates from m)
        select s_suppkey, c_custkey, distance, candidates, count(*) over (partition by c_custkey) > 1 as ambiguous from b where k = 1""",
    "offset_cluster_median": f"""with j as (select l_suppkey, datediff('day', o_orderdate::date, l_shipdate::date) as off from lineitem join orders on l_orderkey = o_orderkey),
        g as (select l_suppkey, round_even(off / 30.0::double, 0)::bigint as cluster, count(*) as n, list(off) as offs from j group by 1, 2 having count(*) >= 3),
        r as (select *, row_number() over (partition by l_suppkey order by n desc, cluster) as k from g)
        select l_suppkey, cluster, n, ({upper('offs')})::bigint as "offset" from r where k = 1""",
    "rolling_median31": f"""with a as (select o_orderkey, list(round(o_totalprice * 100)::bigint) over (partition by o_custkey order by o_orderkey rows between 31 preceding and 1 preceding) as f from orders)
        select o_orderkey, {upper('f')} as median from a where len(f) >= 5""",
    "large_gap": f"""with {EV}, a as (select event_id, user_id, us - lag(us) over (partition by user_id order by event_id) as delta from ev),
        b as (select *, list(delta) over (partition by user_id order by event_id rows between 31 preceding and 1 preceding) as f from a where delta is not null),
        c as (select *, case when len(f) >= 3 then {upper('f')} end as median from b) select event_id, user_id, delta, median from c where delta > 4 * median and delta > 1000000""",
    "band_correlation": f"""with {EV} select a.user_id % 64 as pid, a.event_id as error_id, b.event_id as purchase_id from ev a join ev b on a.user_id % 64 = b.user_id % 64 and abs(a.event_id - b.event_id) <= 400
        where a.event_type = 'error' and b.event_type = 'purchase'""",
    "incident_cluster": f"""with {EV}, e as (select *, lag(event_id) over (order by event_id) as was from ev where event_type = 'error'),
        g as (select *, sum((was is null or event_id - was > 8)::int) over (order by event_id) as run from e)
        select min(event_id) as start_id, max(event_id) as end_id, count(*) as n, count(distinct user_id % 8) as pids from g group by run having count(distinct user_id % 8) >= 3""",
    "merge_intervals": f"with {RG} select * from mi",
    "union_size": f"with {RG} select o_custkey, sum(b - a)::bigint as days, count(*) as parts from mi group by o_custkey",
    "coverage_subtraction": f"""with {EV} select user_id, event_id from ev a where event_type = 'error'
        and not exists (select 1 from ev b where b.user_id = a.user_id and b.event_type = 'purchase' and b.event_id <= a.event_id and a.event_id - b.event_id <= 2000)""",
    "clip_shift": f"""with {EV}, c as (select i as clip, i * 200 as a, i * 200 + 60 + i as b, coalesce(sum(60 + i) over (order by i rows between unbounded preceding and 1 preceding), 0) as before from range(1, 41) r(i))
        select clip, event_id, (event_id - a + before)::bigint as position from ev join c on event_id >= a and event_id < b""",
    "anchor4_match": f"""with {EV}, t as (select event_id, event_type || (user_id % 4)::varchar as token from ev),
        a as (select event_id, list(token) over (order by event_id rows between current row and 3 following) as g from t where event_id < 400),
        b as (select event_id, list(token) over (order by event_id rows between current row and 3 following) as g from t where event_id >= 400 and event_id < 5000)
        select a.event_id as start_a, b.event_id as start_b from a join b on a.g = b.g where len(a.g) = 4""",
    "binary_overlap": f"""with {EV}, a as (select event_id as i, user_id, event_type from ev where event_id < 700), b as (select event_id - 450 as j, user_id, event_type from ev where event_id >= 450 and event_id < 1200),
        m as (select i - j as shift, count(*) as equal, min(j) as low from a join b using (user_id, event_type) group by 1)
        select max(equal) as overlap from m where low = 0 and equal = (select max(i) + 1 from a) - shift and equal >= 32""",
    "donor_choice": """with g as (select l_partkey, l_suppkey, sum(round(l_quantity)::bigint)::bigint as q, sum((l_returnflag = 'R')::int)::bigint as errors from lineitem group by 1, 2),
        r as (select *, row_number() over (partition by l_partkey order by errors, q desc, l_suppkey) as k from g) select l_partkey, l_suppkey, errors, q from r where k = 1""",
    "coverage_matrix": """with d as (select distinct l_partkey, l_suppkey from lineitem), u as (select l_partkey, min(l_suppkey) as l_suppkey from d group by 1 having count(*) = 1),
        n as (select l_suppkey, count(*) as unique_parts from u group by 1)
        select l_suppkey, count(*) filter (l_partkey % 4 = 0) as q0, count(*) filter (l_partkey % 4 = 1) as q1, count(*) filter (l_partkey % 4 = 2) as q2, count(*) filter (l_partkey % 4 = 3) as q3,
          coalesce(max(unique_parts), 0)::bigint as unique_parts from d left join n using (l_suppkey) group by l_suppkey""",
    "service_full_outer": """with n as (select n_nationkey, n_name from nation where n_nationkey < 20), s as (select s_nationkey, count(*) as suppliers from supplier where s_nationkey >= 5 group by 1)
        select coalesce(n_nationkey, s_nationkey) as service_id, n_name as name, suppliers from n full join s on n_nationkey = s_nationkey""",
    "set_union_append": """with u as (select 0 as file, o_orderkey from orders union all select 1, o_orderkey from orders where o_orderkey % 3 = 0)
        select file, o_orderkey, (row_number() over (order by file, o_orderkey) - 1)::bigint as position from u""",
    "cc_renumber": f"""with {PK}, p as (select *, event_id // 2500 as part from pk where not tei),
        e as (select pid, part, arg_min(cc, event_id) as f, arg_max(cc, event_id) as l from p group by 1, 2),
        s as (select *, coalesce(lag(l) over (partition by pid order by part) + 1 - f, 0) as seam from e),
        o as (select pid, part, sum(seam) over (partition by pid order by part) as off from s)
        select event_id, pid, (((cc + off) % 16 + 16) % 16)::int as cc from p join o using (pid, part)""",
    "slot_spread": "select o_orderkey, ceil(row_number() over (order by o_orderkey) * 5 / 7.0::double)::bigint as slot from orders",
    "natural_sort": """with n as (select distinct 'Part' || (s_suppkey % 50)::varchar || case when s_suppkey % 2 = 0 then '.ts' else 'b02.ts' end as name, s_suppkey % 50 as k, s_suppkey % 2 as odd from supplier)
        select name, row_number() over (order by k, odd)::bigint as place from n""",
    "next_same_key": f"with {EV} select event_id, lag(event_id) over w as previous_id, lead(event_id) over w as next_id from ev window w as (partition by user_id order by event_id)",
    "packet_window": f"with {PK} select event_id, pid, cc, tei from pk where event_id between 500 and 563",
    "formats": """with d as (select distinct l_partkey, l_suppkey, l_partkey * 987654 as ms from lineitem)
        select l_partkey, l_suppkey, '0x' || printf('%04X', (l_partkey % 8192)::int) as pid_text,
          printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) as time_text,
          printf('%02d:%02d:%02d.%03d', ms // 3600000 % 24, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) as day_text from d""",
    "size_format": """with p as (select p_partkey, (p_partkey * p_partkey * 1024)::double as n from part)
        select p_partkey, case when n < 1024 then printf('%.2f B', n) when n < 1048576 then printf('%.2f KB', round(n / 1024, 2)) when n < 1073741824 then printf('%.2f MB', round(n / 1048576, 2))
          when n < 1099511627776 then printf('%.2f GB', round(n / 1073741824, 2)) else printf('%.2f TB', round(n / 1099511627776, 2)) end as size_text from p""",
    "parse_literals": "select p_partkey, case when p_partkey % 3 < 2 then p_partkey end as number from part",
    "mjd_to_utc": "select o_orderkey, strftime(date '1858-11-17' + (40000 + o_orderkey % 20000)::int, '%Y-%m-%d') as day from orders",
    "context_range": f"with {EV} select event_id, greatest(0, event_id - 150)::bigint as start_id, least((select max(event_id) from ev), event_id + 150) as end_id from ev where event_type = 'error'",
    "anomaly_markers": f"""with {EV}, s as (select event_id // 50 as pixel, event_id, case event_type when 'error' then 2 when 'purchase' then 1 else 0 end::int as severity from ev),
        r as (select *, row_number() over (partition by pixel order by severity desc, event_id) as k from s) select pixel, severity, event_id from r where k = 1""",
    "anchor_thinning": f"""with {EV}, a as (select event_id, user_id, row_number() over w as nth, max(event_id) over (partition by user_id) as last_id from ev where event_type = 'view' window w as (partition by user_id order by event_id))
        select user_id, event_id from a where nth % 2 = 1 or event_id = last_id""",
    "avg_peak_bitrate": f"with {IV} select sum(packets * 1504)::bigint as bits, max(packets * 1504)::bigint as peak_bits, count(*) as buckets from bk",
    "missing_structure": "select c_custkey, c_nationkey from customer where c_custkey not in (select o_custkey from orders)",
    "event_reach": f"""with {EV}, e as (select event_id, user_id from ev where event_type = 'error')
        select a.event_id, count(distinct b.user_id) as users from e a join e b on b.event_id <= a.event_id and a.event_id - b.event_id <= 30 group by 1""",
}

ORACLES |= {
    "ts_decode": f"""with {PK} select event_id as packet_index, pid, cc, tei, pusi, afc, case when afc = 3 then 7 end::int as af_len, case when afc = 3 then 12 else 4 end::int as payload_offset,
        true as has_payload, case when afc = 3 then pcr_base end as pcr_base from pk""",
    "ts_fault_counts": f"""with {CC},
        q as (select pid, event_id, pcr_base - lag(pcr_base) over (partition by pid order by event_id) as d from pk where afc = 3 and not tei),
        f as (select pid, 'Error' as severity, 'TransportError' as type from pk where tei
          union all select pid, 'Error', 'ContinuityGap' from c2 where missing > 0
          union all select pid, case when d > 900000 then 'Error' else 'Warning' end, case when d > 900000 then 'PcrJump' else 'PcrGap' end from q where d > 45000)
        select pid, severity, type, count(*) as n from f group by all""",
    "ts_merged_faults": f"""with {PK}, a as (select pid, event_id, lag(event_id) over (partition by pid order by event_id) as was from pk where tei),
        b as (select *, sum((was is null or event_id - was > 256)::int) over (partition by pid order by event_id) as s from a)
        select pid, min(event_id) as start_packet, max(event_id) as end_packet, count(*)::bigint as occurrences from b group by pid, s""",
    "ts_same_pid_next": f"with {PK} select event_id as packet_index, pid, lead(event_id) over (partition by pid order by event_id) as next_index from pk",
    "stream_buckets": f"with {EV} select us // 86400000000 as day, event_type, count(*) as n from ev group by 1, 2",
    "stream_continuity": f"""with {EV}, a as (select user_id % 8 as pid, event_id, ((event_id // 8) % 16)::int as cc, event_type = 'error' as tei from ev),
        s as (select *, sum(tei::int) over (partition by pid order by event_id) as stretch from a),
        l as (select *, lag(cc) over (partition by pid, stretch order by event_id) as was from s where not tei)
        select pid::int as pid, event_id as packet_index, case when was = cc then 'Duplicate' else 'Gap' end as fault, case when was = cc then 0 else (cc - was + 31) % 16 end::int as missing
        from l where was is not null and (cc - was + 31) % 16 <> 0""",
}
