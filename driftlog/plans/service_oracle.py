"""The service queries in DuckDB SQL."""

from .inputs import input_sql
from .oracle import VIEWS

EXTRA = ",\n".join(
    f"{name} as ({input_sql(name, 'varchar', 'sha256(text)')})" for name in ("described", "share_events", "batch", "some_owners", "payloads", "pulls", "grants", "revokes", "uploads")
)
# The reference's rule of a push: batches come one after the other; a playlist without an owner goes to the first that names it in a sound operation.
PUSH = """,
gate as (select batch_id, count(*) as n, case when count(*) > 150 then 'too_many' when max(nullif(trim(device_id), '')) is null then 'no_device' else 'ok' end as verdict from batch group by batch_id),
admitted as (select b.*, case when turn % 83 = 0 then 'op' when turn % 29 = 0 or turn % 31 = 0 or turn % 37 = 0 then 'op_id' when turn % 41 = 0 then 'tracks' when turn % 43 = 0 then 'entity' when turn % 47 = 0 then 'operation'
    when turn % 53 = 0 then 'entity_id' when turn % 59 = 0 or turn % 61 = 0 or turn % 67 = 0 then 'payload' when turn % 71 = 0 then 'depth' when turn % 73 = 0 then 'size' when turn % 79 = 0 then 'created_at' end as fault
  from batch b where batch_id in (select batch_id from gate where verdict = 'ok')),
sound as (select * from admitted where fault is null and playlist_id <> ''),
claims as (select distinct playlist_id, first_value(user_id) over (partition by playlist_id order by turn) as owner_user_id from sound where playlist_id not in (select playlist_id from some_owners)),
owned as (select playlist_id, owner_user_id from some_owners union all select playlist_id, owner_user_id from claims),
judged as (select a.*, coalesce(fault, case
    when playlist_id = '' then case when exists (select 1 from sound s where s.batch_id = a.batch_id) then 'denied' end
    when exists (select 1 from owned o where o.playlist_id = a.playlist_id and o.owner_user_id <> a.user_id)
      and not exists (select 1 from shares s where s.playlist_id = a.playlist_id and s.grantee_user_id = a.user_id and s.can_edit = 1) then 'denied' end) as reason from admitted a),
accepted as (select * from judged where reason is null),
kept as (select user_id, op_id, turn as seq, entity, entity_id from accepted where turn % 6 = 0),
fresh as (select user_id, op_id, min(turn) as turn from accepted a where not exists (select 1 from kept k where k.user_id = a.user_id and k.op_id = a.op_id) group by user_id, op_id),
new as (select user_id, op_id, (select coalesce(max(seq), 0) from kept) + row_number() over (order by turn) as seq, turn from fresh),
queues as (select user_id, entity_id, seq from kept where entity = 'queue_state' union all select a.user_id, a.entity_id, n.seq from new n join accepted a on a.turn = n.turn where a.entity = 'queue_state')"""
# The reference's export of a user: its playlists one after the other, each seeing the items as the earlier ones left them; '' is no stamp, '-' a deleted item.
EXPORT = ",\nfolded as (select * from state where entity = 'playlists'),\nplaylists as (" + input_sql("playlists", "varchar") + """),
listed as (select i.user_id, i.playlist_id, i.track_id, i.entity_id, i.seq, i.track_id in (select p_partkey from part where p_size > 10) as there
  from items i join lists l on l.user_id = i.user_id and l.playlist_id = i.playlist_id),
tracks as (select user_id, playlist_id, coalesce(string_agg(cast(track_id as varchar), ',' order by entity_id, seq) filter (there), '') as resolved, count(*) filter (not there) as unresolved from listed group by all),
bare as (select p.*, coalesce(t.resolved, '') as resolved, coalesce(t.unresolved, 0) as unresolved, p.image_hash is not null and not p.has_image as artwork_missing,
  upper(sha256(p.name || chr(10) || coalesce(p.image_hash, '') || chr(10) || case when coalesce(t.resolved, '') = '' then '' else t.resolved || ',' end)) as content_hash
  from playlists p left join tracks t on t.user_id = p.user_id and t.playlist_id = p.playlist_id),
hashed as (select *, content_hash || case when artwork_missing then ':pending-artwork' else '' end as stored_hash from bare),
mapped as (""" + input_sql("mapped", "varchar") + "),\ncatalog as (" + input_sql("items", "varchar") + """),
turns as (select h.*, m.target_item_id, coalesce(m.content_hash = h.content_hash, false) as same, row_number() over (partition by h.user_id order by h.seq, h.playlist_id) as nth
  from hashed h left join mapped m on m.user_id = h.user_id and m.playlist_id = h.playlist_id),
start as (select user_id, map_from_entries(list({'k': item_id, 'v': coalesce(stamp, '')})) as stamps, list({'item': item_id, 'name': lower(name)}) as named from catalog group by user_id),
walk as (
  select user_id, cast(0 as bigint) as nth, stamps, named, '' as playlist_id, '' as action, cast(null as varchar) as item from start
  union all
  select user_id, nth, case when action in ('updated', 'adopted') then map_concat(stamps, map([item], [playlist_id])) when action = 'deleted' then map_concat(stamps, map([item], ['-'])) else stamps end, named, playlist_id, action,
    item
  from (select *, case action when 'adopted' then case when by_id then source_id else only_named[1] end when 'created' then null else target_item_id end as item
    from (select *, case when is_smart then 'skipped_smart' when target_item_id = 'broken' then 'error'
        when deleted then case when target_item_id is null then 'gone' when now not in ('', '-') then 'deleted' else 'forgotten' end
        when now <> '-' and same and now = playlist_id then 'unchanged' when now <> '-' then 'updated'
        when by_id or len(only_named) = 1 then 'adopted' else 'created' end as action
      from (select t.user_id, t.nth, w.stamps, w.named, t.playlist_id, t.is_smart, t.deleted, t.same, t.target_item_id, t.source_id, coalesce(w.stamps[t.target_item_id], '-') as now,
          coalesce(w.stamps[t.source_id] in ('', t.playlist_id), false) as by_id, list_transform(list_filter(w.named, lambda x: x.name = lower(t.name) and w.stamps[x.item] = ''), lambda x: x.item) as only_named
        from walk w join turns t on t.user_id = w.user_id and t.nth = w.nth + 1)))),
plan as (select w.user_id, w.playlist_id, w.action, w.item as target_item_id, h.stored_hash from walk w join hashed h on h.user_id = w.user_id and h.playlist_id = w.playlist_id where nth > 0),
art as (select p.user_id, p.playlist_id, case when h.artwork_missing then 'missing' when c.image = h.image_hash then 'current' else 'applied' end as artwork
  from plan p join hashed h on h.user_id = p.user_id and h.playlist_id = p.playlist_id left join catalog c on c.user_id = p.user_id and c.item_id = p.target_item_id
  where p.action in ('updated', 'adopted', 'created') and h.image_hash is not null)"""
PAYLOAD = """select seq, case seq % 12 when 0 then 'a' when 1 then '12' when 11 then '1.5' end as name, operation = 'delete' or seq % 12 in (0, 2, 3, 9) as deleted,
  case seq % 12 when 0 then 5 when 1 then 7 when 10 then 11 else created_at end as stamp,
  case entity when 'playlists' then entity_id when 'playlist_items' then case seq % 12 when 3 then 'p1' when 4 then 'p2' when 5 then 'p3' when 9 then 'p4' end end as routed from payloads"""
SAFE = """safe as (select user_id, coalesce(min(case when greatest(0, (1706745600000 - updated_at) // 86400000) <= 3 then cursor end), 0) as safe_cursor, count(*) as devices,
  count(*) filter (greatest(0, (1706745600000 - updated_at) // 86400000) <= 3) as active_devices from device_cursors group by user_id),
kept_ops as (select o.*, coalesce(s.safe_cursor, 0) as safe_cursor, coalesce(s.devices, 0) as devices, coalesce(s.active_devices, 0) as active_devices, max(o.seq) over (partition by o.user_id) as head,
  o.entity = 'play_events' and o.seq <= coalesce(s.safe_cursor, 0) and o.received_at < 1706745600000 - 3 * 86400000 and o.seq < max(o.seq) over (partition by o.user_id) as prunable from ops o left join safe s on s.user_id = o.user_id)"""
BODIES = """numbered as (select cast(seq // 50 as bigint) as batch_id, row_number() over (partition by seq // 50 order by seq) - 1 as place, * from ops),
body_rows as (select batch_id, cast(place + case when batch_id % 10 = 5 then 1 else 0 end as integer) as nth, case when batch_id % 10 = 5 then 'e' else 'd' end as device_id, op_id, entity_id,
    case when entity = 'playlist_items' then '{ "playlistId" : "' || playlist_id || '",  "n":1.50, "m": [ ] }' else payload end as payload, created_at, entity, playlist_id as routed
  from numbered where batch_id % 10 in (5, 6, 7, 8, 9)
  union all select distinct batch_id, 0, 'e', null, null, null, null, null, null from numbered where batch_id % 10 = 5),
body_owners as (select playlist_id, owner_user_id from some_owners union all select distinct routed, first_value(batch_id % 7) over (partition by routed order by batch_id, nth)
  from body_rows where routed is not null and routed not in (select playlist_id from some_owners))"""
# Each kind of payload in ``described``, by what the reference reads in it.
PROJECTED = """told as (select d.*, o.playlist_id as pl, o.track_id, case when entity = 'playlists' and seq % 6 = 3 or entity = 'playlists' and seq % 6 = 5 then created_at else o.stamp end as stamped,
    operation = 'delete' or entity = 'playlists' and seq % 6 = 2 or entity = 'playlist_items' and seq % 7 = 4 as gone
  from described d join ops o using (seq, user_id, entity, entity_id, operation, created_at) where entity = 'playlists' and seq % 6 <> 4 or entity = 'playlist_items' and seq % 7 <> 6),
last_told as (select *, min(seq) over (partition by user_id, entity, entity_id) as first, row_number() over (partition by user_id, entity, entity_id order by stamped desc, seq desc) as nth from told),
in_lists as (select user_id, pl, first, case seq % 7 when 0 then 't' || track_id else cast(track_id as varchar) end as track, case seq % 7 when 0 then 'a' || (track_id % 10) else '3' end as position
  from last_told where nth = 1 and entity = 'playlist_items' and not gone and seq % 7 in (0, 1)),
joined_lists as (select user_id, pl, string_agg(track, ',' order by position, first) as tracks from in_lists group by user_id, pl)"""
SHARING = """asked as (select e.*, w.owner_user_id as owner, e.grantee_user_id in (select c_custkey from customer) as known from share_events e left join owners w on w.playlist_id = e.playlist_id),
ruled as (select *, case when kind = 'share' then case when trim(playlist_id) = '' then 'playlist' when not coalesce(known, false) then 'user' when grantee_user_id = actor then 'self' when owner is null then 'unknown' when owner <> actor then 'not_owner' end
    when owner is null then 'unknown' when owner <> actor and grantee_user_id is distinct from actor then 'not_yours' end as reason from asked),
share_log as (select playlist_id, grantee_user_id, -1 as turn, 'share' as kind, can_edit, created_at from shares
  union all select playlist_id, grantee_user_id, turn, kind, coalesce(can_edit, 1), created_at from ruled where reason is null),
stood_at as (select r.*, coalesce((select arg_max(l.kind, l.turn) from share_log l where l.playlist_id = r.playlist_id and l.grantee_user_id = r.grantee_user_id and l.turn < r.turn) = 'share', false) as stood from ruled r)"""
PAGES = """behind as (select user_id, device_id, case when cursor % 3 = 0 then cursor % 50 else cursor - cursor % 400 end as cursor from device_cursors),
seen_lists as (select owner_user_id as user_id, playlist_id from owners union select grantee_user_id, playlist_id from shares),
seen_rows as (select b.user_id, b.device_id, o.seq, o.op_id, row_number() over (partition by b.user_id, b.device_id order by o.seq) as nth from behind b join ops o on o.seq > b.cursor
  and (o.user_id = b.user_id or exists (select 1 from seen_lists l where l.user_id = b.user_id and l.playlist_id = o.playlist_id)))"""
JUDGED_UPLOADS = """sent as (select user_id, turn, text, lower(trim(string_split(mime_type, ';')[1])) as mime, case when turn % 6 in (1, 2) then 'type' when strlen(text) = 0 then 'empty' when strlen(text) > 20000 then 'size'
  when turn % 5 = 1 then 'hash_form' when turn % 5 = 2 then 'hash' end as reason from uploads)"""
BODY = {
    "batch_gate": ("", "select * from gate"),
    "push_accepted": ("", "select batch_id, turn from accepted"),
    "push_rejected": ("", "select batch_id, turn, reason from judged where reason is not null"),
    "assign_seq": ("", "select user_id, op_id, seq from new"),
    "push_superfluous": ("", "select user_id, entity_id, seq from queues q where exists (select 1 from queues r where r.user_id = q.user_id and r.entity_id = q.entity_id and r.seq > q.seq)"),
    "push_head": ("", "select user_id, max(seq) as head from (select user_id, seq from kept union all select user_id, seq from new) where user_id in (select user_id from new) group by user_id"),
    "push_owners": ("", "select * from owned"),
    "batch_targets": ("", "select distinct batch_id, 'playlist' as kind, playlist_id as target from batch where playlist_id is not null union all select distinct batch_id, 'queue', entity_id from batch where entity = 'queue_state'"),
    "body_refused": ("", "select distinct cast(seq // 50 as bigint) as batch_id, (seq // 50) % 10 in (0, 1, 3, 4) as refused from ops"),
    "body_ops": (BODIES, "select * exclude (entity, routed) from body_rows"),
    "body_push": (BODIES, """select batch_id, nth, routed as playlist_id, coalesce(case when op_id is null then 'op' end, case
      when exists (select 1 from body_owners o where o.playlist_id = routed and o.owner_user_id <> batch_id % 7)
        and not exists (select 1 from shares s where s.playlist_id = routed and s.grantee_user_id = batch_id % 7 and s.can_edit = 1) then 'denied' end) as reason
      from body_rows where batch_id in (select batch_id from body_rows group by batch_id having count(*) <= 150)"""),
    "payload_fields": ("", PAYLOAD),
    "playlist_id_of": ("", f"select routed, count(*) as n from ({PAYLOAD}) where routed is not null group by routed"),
    "pull_limit": ("", "select seq, cast(least(60, greatest(1, case when track_id % 7 = 0 then 50 else track_id - 20 end)) as bigint) as page, cast(case when track_id % 3 = 0 then 30 else greatest(30, track_id) end as bigint) as days from ops"),
    "pull_cursor_event": ("", "select cast(coalesce((select max(seq) from (select seq from page order by seq limit 50)), 100) as bigint) as cursor"),
    "guid_users": ("", "select distinct case when user_id % 8 = 3 then printf('%032x', user_id) else lower(printf('%08x', user_id)) || '00004000800000000000000a' end as user_id from ops where user_id % 8 in (0, 2, 3, 6, 7)"),
    "share_verdicts": (SHARING, "select turn, kind, coalesce(reason, case when kind = 'revoke' and not stood then 'no_share' end) as reason from stood_at"),
    "shares_after_requests": (SHARING, """select playlist_id, grantee_user_id, arg_max(can_edit, turn) as can_edit, arg_min(created_at, turn) as created_at from share_log l where kind = 'share'
      and not exists (select 1 from share_log r where r.playlist_id = l.playlist_id and r.grantee_user_id = l.grantee_user_id and r.kind = 'revoke' and r.turn > l.turn) group by 1, 2"""),
    "storage_status": ("", "select max(seq) as head, count(*) as n, count(distinct user_id) as users from ops"),
    "device_cursor_upsert": ("", "select user_id, device_id, max(cursor) as cursor, arg_max(updated_at, turn) as updated_at from (select user_id, device_id, cursor, updated_at, -1 as turn from device_cursors union all select user_id, device_id, cursor, updated_at, turn from pulls) group by 1, 2"),
    "share_upsert": ("", "select playlist_id, grantee_user_id, arg_max(can_edit, turn) as can_edit, arg_min(created_at, turn) as created_at from (select playlist_id, grantee_user_id, can_edit, created_at, -1 as turn from shares union all select playlist_id, grantee_user_id, can_edit, created_at, turn from grants) group by 1, 2"),
    "share_revoke": ("", "select playlist_id, grantee_user_id, grantee_user_id <> -5 as existed from (select distinct playlist_id, grantee_user_id from revokes)"),
    "shares_left": ("", "select playlist_id, grantee_user_id, can_edit from shares where grantee_user_id % 2 <> 0"),
    "share_names": ("", "select s.playlist_id, s.grantee_user_id, c.c_name as user_name from shares s left join customer c on c.c_custkey = s.grantee_user_id"),
    "retention_report": (SAFE, "select user_id, count(*) as n, count(*) filter (entity = 'play_events') as play_events, max(head) as head, max(safe_cursor) as safe_cursor, count(*) filter (prunable) as prunable, max(devices) as devices, max(active_devices) as active_devices from kept_ops group by user_id"),
    "retention_survivors": (SAFE, "select seq, user_id from kept_ops where not prunable"),
    "queue_listing": ("", "select user_id, entity_id as device_id, seq, entity_id = 'd1' as is_current, greatest(0, (1706745600000 - received_at) // 1000) as age_seconds, 'upsert' as operation, cast(row_number() over (partition by user_id order by seq desc) as integer) as nth from queue where nth = 1"),
    "blob_integrity": (JUDGED_UPLOADS, "select user_id, turn, mime, reason from sent"),
    "blob_upload": (JUDGED_UPLOADS, "select * from (select user_id, image_hash, size, created_at from blobs where size % 3 = 0) old union all select user_id, sha256(text), min(strlen(text)), min(turn) from sent u where reason is null and not exists (select 1 from blobs b where b.size % 3 = 0 and b.user_id = u.user_id and b.image_hash = sha256(u.text)) group by 1, 2"),
    "blob_list": ("", "select user_id, image_hash, size, cast(row_number() over (partition by user_id order by created_at desc, image_hash) as integer) as nth from blobs".replace("order by created_at desc", "order by greatest(0, (1706745600000 - created_at) // 86400000) desc, created_at desc")),
    "blob_lookup": ("", "select user_id, case when image_hash < '8' then upper(image_hash) else image_hash end as image_hash, not (image_hash < '8' and upper(image_hash) <> image_hash) as found, case when not (image_hash < '8' and upper(image_hash) <> image_hash) then size end as size from blobs"),
    "orphan_listing": ("", "select user_id, image_hash, age_days, cast(row_number() over (partition by user_id order by age_days desc, created_at desc, image_hash) as integer) as nth from orphans where orphan"),
    "reclaim_report": ("", "select user_id, count(*) filter (gone) as reclaimed, cast(coalesce(sum(size) filter (gone), 0) as bigint) as reclaimed_bytes, count(*) filter (not gone) as remaining, cast(coalesce(sum(size) filter (not gone), 0) as bigint) as remaining_bytes from (select *, orphan and age_days >= 10 as gone from orphans) group by user_id"),
    "store_pull_page": ("", "select * from page"),
    "store_playlist_ops": ("", "select seq, entity, entity_id, playlist_id, operation, cast(row_number() over (order by seq) as integer) as nth from ops where user_id = (select me from viewer) and entity in ('playlists', 'playlist_items')"),
    "store_pruned": ("", "select seq, user_id, entity from marked where not prunable"),
    "store_compacted": ("", "select seq, user_id, entity from ops where entity <> 'queue_state' or seq in (select seq from queue where nth = 1)"),
    "store_summary": ("", "select user_id, count(*) as n, count(*) filter (entity = 'play_events') as play_events, max(seq) as head from marked where not prunable and (entity <> 'queue_state' or seq in (select seq from queue where nth = 1)) group by user_id"),
    "store_push": ("", "select n.user_id, n.op_id, n.seq, a.entity, a.playlist_id, o.owner_user_id from new n join accepted a on a.turn = n.turn left join owned o on o.playlist_id = a.playlist_id"),
    "queue_stream": ("", "select user_id, entity_id, seq, payload, received_at from queue where nth = 1"),
    "store_ingest": ("", """select row_number() over (order by turn) as seq, user_id, op_id, entity from (select user_id, op_id, min(turn) as turn, min(entity) as entity from (
      select user_id, op_id, entity, 10 * seq + ((seq % 18) // 6) * 10000000000 as turn from ops
      union all select user_id, op_id, entity, 10 * seq + 1 + (seq % 3) * 10000000000 from ops where seq % 7 = 0 and seq % 2 = (seq % 3) % 2) group by user_id, op_id)"""),
    "projected_playlists": (PROJECTED, """select p.user_id, entity_id as playlist_id, first as seq, case seq % 6 when 0 then 'N' || track_id when 1 then 'M' when 2 then '5' when 5 then 'K' else '' end as name, seq % 6 in (1, 5) as is_smart,
      gone as deleted, case seq % 6 when 1 then 's' || track_id when 5 then '7' end as source_id, case seq % 6 when 3 then 'h' || track_id when 5 then 'g' end as image_hash, coalesce(tracks, '') as tracks
      from last_told p left join joined_lists j on j.user_id = p.user_id and j.pl = p.entity_id where nth = 1 and entity = 'playlists'"""),
    "routed_anew": ("", "select seq, case entity when 'playlists' then entity_id when 'playlist_items' then case when seq % 7 = 5 then 'p2' when seq % 7 < 5 then playlist_id end end as playlist_id from ops"),
    "owners_anew": ("", "select entity_id as playlist_id, arg_min(user_id, seq) as owner_user_id, min(seq) as created_at from ops where entity = 'playlists' group by entity_id"),
    "device_pages": (PAGES, "select user_id, device_id, seq, op_id, cast(nth as integer) as nth from seen_rows where nth <= 21"),
    "device_cursors_pulled": (PAGES, "select b.user_id, b.device_id, coalesce(max(seq) filter (nth <= 20), any_value(b.cursor)) as cursor, coalesce(max(nth) > 20, false) as has_more from behind b left join seen_rows s on s.user_id = b.user_id and s.device_id = b.device_id group by 1, 2"),
    "resolved_tracks": ("", "select user_id, playlist_id, resolved, unresolved, artwork_missing, content_hash from hashed"),
    "export_map": ("", "select user_id, playlist_id, target_item_id, content_hash from mapped"),
    "export_plan": ("", "select * from plan"),
    "adopt_targets": ("", "select user_id, playlist_id, target_item_id from plan where action = 'adopted'"),
    "export_artwork": ("", "select * from art"),
    "export_report": ("", "select p.user_id, " + ", ".join(f"count(*) filter (action = '{a}') as {a}" for a in ("skipped_smart", "deleted", "forgotten", "unchanged", "updated", "adopted", "created"))
        + ", cast(coalesce(sum(h.unresolved) filter (not h.is_smart and not h.deleted), 0) as bigint) as unresolved, count(*) filter (artwork = 'applied') as artwork_applied, count(*) filter (artwork = 'missing') as artwork_missing, count(*) filter (action = 'error') as errors"
        + " from plan p join hashed h on h.user_id = p.user_id and h.playlist_id = p.playlist_id left join art a on a.user_id = p.user_id and a.playlist_id = p.playlist_id group by p.user_id"),
    "export_map_upsert": ("", "select m.user_id, m.playlist_id, m.target_item_id, m.content_hash from mapped m left join plan p on p.user_id = m.user_id and p.playlist_id = m.playlist_id where coalesce(p.action, '') not in ('deleted', 'forgotten', 'updated', 'adopted', 'created') union all select user_id, playlist_id, target_item_id, stored_hash from plan where action in ('updated', 'adopted', 'created')"),
}
EXPORTS = ("export_artwork", "resolved_tracks", "export_map", "export_plan", "adopt_targets", "export_report", "export_map_upsert")
SQL = {name: f"with recursive {VIEWS}, {EXTRA}{PUSH}{EXPORT if name in EXPORTS else ''}{', ' + more if more else ''} {body}" for name, (more, body) in BODY.items()}
