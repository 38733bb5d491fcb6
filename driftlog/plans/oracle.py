"""The queries in DuckDB SQL."""

VIEWS = """
ops as (
select event_id + 1 as seq, cast(event_id as varchar) as op_id, user_id, concat('d', cast(event_id % 4 as varchar)) as device_id,
  case event_type when 'purchase' then 'playlists' when 'click' then 'playlist_items' when 'view' then 'play_events' when 'signup' then 'queue_state' else 'likes' end as entity,
  case event_type when 'purchase' then concat('p', cast(cast(json_extract_string(props, '$.k') as bigint) % 20 as varchar))
    when 'click' then concat('i', cast(cast(json_extract_string(props, '$.k') as bigint) as varchar))
    when 'signup' then concat('d', cast(event_id % 4 as varchar)) else concat('e', cast(event_id as varchar)) end as entity_id,
  case when event_type in ('purchase', 'click') then concat('p', cast(cast(json_extract_string(props, '$.k') as bigint) % 20 as varchar)) end as playlist_id,
  case when event_id % 11 = 0 then 'delete' else 'upsert' end as operation, props as payload,
  (epoch_us(ts) // 1000) as created_at, (epoch_us(ts) // 1000) + event_id % 60000 as received_at, cast(floor(value * 100) as bigint) as stamp,
  cast(json_extract_string(props, '$.k') as bigint) as track_id
from events),
owners as (select playlist_id, arg_min(user_id, seq) as owner_user_id, min(received_at) as created_at from ops where entity = 'playlists' group by playlist_id),
shares as (select o.playlist_id, g.owner_user_id as grantee_user_id, max(cast(substr(o.playlist_id, 2) as int) % 2) as can_edit, min(o.created_at) as created_at
  from owners o join owners g on cast(substr(g.playlist_id, 2) as int) in ((cast(substr(o.playlist_id, 2) as int) + 1) % 20, (cast(substr(o.playlist_id, 2) as int) + 2) % 20)
  where g.owner_user_id <> o.owner_user_id group by o.playlist_id, g.owner_user_id),
viewer as (select owner_user_id as me from owners where playlist_id = 'p0'),
device_cursors as (select user_id, device_id, max(seq) as cursor, max(received_at) as updated_at from ops where seq % 5 <> 0 group by user_id, device_id),
blobs as (select doc_id % 7 as user_id, sha256(text) as image_hash, max(strlen(text)) as size, min(1704067200000 + (doc_id % 60) * 86400000) as created_at from documents group by doc_id % 7, sha256(text)),
live_refs as (select distinct d.doc_id % 7 as user_id, sha256(d.text) as image_hash from documents d join labels l on l.doc_id = d.doc_id where l.quality = 1 and l.toxic = 0),
orphans as (select b.*, r.image_hash is null as orphan, greatest(0, cast(floor((1706745600000 - b.created_at) / 86400000) as bigint)) as age_days
  from blobs b left join live_refs r on r.user_id = b.user_id and r.image_hash = b.image_hash),
page as (select seq, op_id, user_id from ops where seq > 100 and (user_id = (select me from viewer) or playlist_id in (select playlist_id from owners where owner_user_id = (select me from viewer))
  or playlist_id in (select playlist_id from shares where grantee_user_id = (select me from viewer))) order by seq limit 51),
denied as (select o.playlist_id from owners o where o.owner_user_id <> (select me from viewer)
  and not exists (select 1 from shares s where s.playlist_id = o.playlist_id and s.grantee_user_id = (select me from viewer) and s.can_edit = 1)),
marked as (select o.*, entity = 'play_events' and seq <= 8000 and received_at < 1706000000000 and seq < max(seq) over (partition by user_id) as prunable from ops o),
queue as (select *, row_number() over (partition by user_id, entity_id order by seq desc) as nth from ops where entity = 'queue_state'),
state as (select * from (select *, row_number() over (partition by user_id, entity, entity_id order by stamp desc, seq desc) as nth from ops) where nth = 1),
items as (select user_id, playlist_id, entity_id, seq, track_id from state where entity = 'playlist_items' and operation <> 'delete'),
lists as (select user_id, entity_id as playlist_id from state where entity = 'playlists' and operation <> 'delete')
"""
BODY = {
    "pull_page": "select * from page",
    "pull_meta": "select count(*) > 50 as has_more, cast(coalesce((select max(seq) from (select seq from page order by seq limit 50)), 100) as bigint) as cursor from page",
    "head_cursor": "select user_id, max(seq) as head from ops group by user_id",
    "op_count": "select user_id, count(*) as n from ops group by user_id",
    "list_users": "select distinct user_id from ops",
    "count_by_entity": "select entity, count(*) as n from ops group by entity",
    "playlist_ops": "select user_id, seq, entity, entity_id, playlist_id, operation from ops where entity in ('playlists', 'playlist_items')",
    "validate_ops": "select case when seq % 13 = 0 then 'tracks' end as reason, count(*) as n from ops group by 1",
    "payload_depth": "select cast(len(regexp_extract_all(payload, '\\{')) as integer) as depth, count(*) as n from ops group by 1",
    "append_dedup": "select user_id, op_id, min(seq) as seq from ops group by user_id, op_id",
    "first_writer": "select * from owners",
    "writable_playlists": "select playlist_id from owners where playlist_id not in (select playlist_id from denied)",
    "denied_playlists": "select * from denied",
    "list_shares": "select s.playlist_id, o.owner_user_id, s.grantee_user_id, s.can_edit, s.created_at, o.owner_user_id = v.me as is_owner from shares s join owners o on o.playlist_id = s.playlist_id join viewer v on o.owner_user_id = v.me or s.grantee_user_id = v.me",
    "device_activity": "select * from device_cursors",
    "safe_cursor": "select user_id, coalesce(min(case when greatest(0, cast(floor((1706745600000 - updated_at) / 86400000) as bigint)) <= 3 then cursor end), 0) as safe_cursor from device_cursors group by user_id",
    "prunable_count": "select user_id, count(*) as n from marked where prunable group by user_id",
    "prune_survivors": "select seq, user_id from marked where not prunable",
    "queue_latest": "select user_id, entity_id, seq, payload, received_at from queue where nth = 1",
    "queue_compact_survivors": "select seq, user_id, entity_id from queue where nth = 1",
    "queue_compact_removed": "select user_id, count(*) as removed from queue where nth > 1 group by user_id",
    "lww_playlists": "select user_id, entity_id, seq from state where entity = 'playlists'",
    "playlist_members": "select l.user_id, l.playlist_id, coalesce(string_agg(cast(i.track_id as varchar), ',' order by i.entity_id, i.seq), '') as tracks from lists l left join items i on i.user_id = l.user_id and i.playlist_id = l.playlist_id group by 1, 2",
    "content_hash": "select l.user_id, l.playlist_id, upper(sha256(l.playlist_id || chr(10) || chr(10) || coalesce(string_agg(cast(i.track_id as varchar) || ',', '' order by i.entity_id, i.seq), ''))) as content_hash from lists l left join items i on i.user_id = l.user_id and i.playlist_id = l.playlist_id group by 1, 2",
    "unresolved_tracks": "select l.user_id, l.playlist_id, count(*) as unresolved from lists l join items i on i.user_id = l.user_id and i.playlist_id = l.playlist_id where i.track_id not in (select p_partkey from part where p_size > 10) group by 1, 2",
    "referenced_hashes": "select * from live_refs",
    "blob_dedup": "select * from blobs",
    "orphan_report": "select user_id, image_hash, size, age_days, age_days >= 10 as reclaimable from orphans where orphan",
    "orphan_totals": "select user_id, count(*) as total_blobs, cast(sum(size) as bigint) as total_bytes, cast(sum(case when orphan then size else 0 end) as bigint) as orphan_bytes, cast(count(*) filter (orphan and age_days >= 10) as bigint) as reclaimable from orphans group by user_id",
    "reclaim_survivors": "select user_id, image_hash from orphans where not (orphan and age_days >= 10)",
}
SQL = {name: f"with {VIEWS} {body}" for name, body in BODY.items()}
