"""Pushed batches, payloads, grants, uploads and catalogs over the driver tables: SQL texts that both engines read.

Each text defines an input only; ``STRING`` stands for the engine's text type. The operators' results are stated apart.
"""

DEEP = "concat(repeat('{\"a\":', 33), '1', repeat('}', 33))"
BIG = "concat('{\"a\":\"', repeat('é', 131072), '\"}')"
INPUTS = {
    # one batch per square root; faults by arrival number
    "batch": """select b.turn, b.batch_id, coalesce(w.owner_user_id, -1) as user_id, b.device_id, b.op_id, b.entity, b.operation, b.entity_id, b.payload, b.created_at, b.received_at, b.playlist_id from (
      select seq as turn, cast(floor(sqrt(seq)) as bigint) as batch_id, received_at,
      case when cast(floor(sqrt(seq)) as bigint) % 19 = 0 then ' ' when cast(floor(sqrt(seq)) as bigint) % 17 <> 0 then concat('d', cast(cast(floor(sqrt(seq)) as bigint) % 4 as STRING)) end as device_id,
      case when seq % 83 = 0 then null when seq % 29 = 0 then ' ' when seq % 31 = 0 then repeat('x', 129) when seq % 37 = 0 then repeat('😀', 65)
        when seq % 10 = 9 then concat('o', cast(seq - 1 as STRING)) else concat('o', cast(seq as STRING)) end as op_id,
      case when seq % 83 = 0 then null when seq % 41 = 0 then 'tracks' when seq % 43 = 0 then 'albums' else entity end as entity,
      case when seq % 83 = 0 then null when seq % 47 = 0 then 'UPSERT' else operation end as operation,
      case when seq % 83 = 0 then null when seq % 53 = 0 then '' else entity_id end as entity_id,
      case when seq % 83 = 0 then null when seq % 59 = 0 then '[1]' when seq % 61 = 0 then '{bad' when seq % 67 = 0 then '{"a":1} trailing' when seq % 71 = 0 then DEEP when seq % 73 = 0 then BIG else payload end as payload,
      case when seq % 83 = 0 then null when seq % 79 = 0 then 0 else created_at end as created_at,
      case when seq % 83 = 0 then null when seq % 97 = 0 and entity = 'playlist_items' then '' else playlist_id end as playlist_id
      from ops) b left join owners w on w.playlist_id = concat('p', cast(b.batch_id % 7 as STRING))""".replace("DEEP", DEEP).replace("BIG", BIG),
    "some_owners": "select * from owners where cast(substr(playlist_id, 2) as int) % 3 <> 0",
    "payloads": """select seq, entity, entity_id, operation, created_at, case seq % 12
      when 0 then '{"updated_at": 5, "deleted": true, "name": "a"}' when 1 then '{"updatedAt": 7, "deleted": 0, "name": 12}'
      when 2 then '{"updated_at": null, "updatedAt": 9, "deleted": "TRUE", "name": null}' when 3 then '{"updated_at": "8", "deleted": "1", "playlist_id": "p1"}'
      when 4 then '{"updated_at": 1.5, "deleted": "no", "playlistId": "p2"}' when 5 then '{"playlist_id": 3, "playlistId": "p3", "deleted": null}'
      when 6 then '[1]' when 7 then '{bad' when 9 then '{"deleted": 2, "playlist_id": null, "playlistId": "p4"}'
      when 10 then '{"name": true, "deleted": false, "updated_at": 11}' when 11 then '{"deleted": {"a": 1}, "name": 1.5}' end as payload from ops""",
    # playlists and items as clients write them, in several spellings, some broken
    "described": """select user_id, entity, entity_id, operation, created_at, seq, case when entity = 'playlists' then case seq % 6
      when 0 then concat('{"name":"N', cast(track_id as STRING), '","updated_at":', cast(stamp as STRING), ',"is_smart":0}')
      when 1 then concat('{"name":"M","updatedAt":', cast(stamp as STRING), ',"isSmart":true,"sourceJellyfinId":"s', cast(track_id as STRING), '"}')
      when 2 then concat('{"name":5,"deleted":1,"updated_at":', cast(stamp as STRING), '}')
      when 3 then concat('{"image_hash":"h', cast(track_id as STRING), '","updated_at":null,"updatedAt":3}') when 4 then '[1]'
      else concat('{"name":"K","imageHash":"g","is_smart":"1","source_jellyfin_id":7,"updated_at":', cast(stamp as STRING), '.5}') end
      when entity = 'playlist_items' then case seq % 7
      when 0 then concat('{"playlist_id":"', playlist_id, '","jellyfin_id":"t', cast(track_id as STRING), '","position":"a', cast(track_id % 10 as STRING), '","updated_at":', cast(stamp as STRING), '}')
      when 1 then concat('{"playlistId":"', playlist_id, '","jellyfinId":', cast(track_id as STRING), ',"position":3,"updated_at":', cast(stamp as STRING), '}')
      when 2 then concat('{"playlist_id":"', playlist_id, '","updated_at":', cast(stamp as STRING), '}') when 3 then concat('{"playlist_id":"', playlist_id, '","jellyfin_id":"","updated_at":', cast(stamp as STRING), '}')
      when 4 then concat('{"deleted":"true","playlist_id":"', playlist_id, '","jellyfin_id":"x","updated_at":', cast(stamp as STRING), '}')
      when 5 then concat('{"playlist_id":null,"playlistId":"p2","jellyfin_id":"t1","updated_at":', cast(stamp as STRING), '}') else '{bad' end
      else '{}' end as payload from ops""",
    "pulls": "select user_id, device_id, seq % 7000 as cursor, received_at as updated_at, seq as turn from ops where seq % 5 = 0",
    "grants": """select playlist_id, user_id as grantee_user_id, cast(seq % 2 as int) as can_edit, received_at as created_at, seq as turn from ops where entity = 'playlists' and seq % 3 = 0
      union all select playlist_id, grantee_user_id, 1 - can_edit, created_at + 5, 7 from shares""",
    "share_events": """select o.seq as turn, case when o.seq % 4 = 3 then 'revoke' else 'share' end as kind, case when o.seq % 5 = 0 then o.user_id else w.owner_user_id end as actor,
      case when o.seq % 11 = 0 then ' ' when o.seq % 13 = 0 then 'nope' else o.playlist_id end as playlist_id, case o.seq % 6 when 0 then null when 1 then -7 when 2 then w.owner_user_id else o.user_id % 5 end as grantee_user_id,
      case when o.seq % 7 > 0 then cast(o.seq % 2 as int) end as can_edit, o.received_at as created_at from ops o left join owners w on w.playlist_id = o.playlist_id where o.entity = 'playlists'""",
    "revokes": "select playlist_id, grantee_user_id from shares where grantee_user_id % 2 = 0 union all select playlist_id, -5 as grantee_user_id from owners",
    "uploads": """select doc_id % 7 as user_id, doc_id as turn,
      case doc_id % 6 when 0 then 'image/PNG; charset=x' when 1 then 'text/plain' when 2 then null when 3 then ' image/webp ' else 'image/jpeg' end as mime_type,
      case doc_id % 5 when 0 then upper(DIGEST) when 1 then 'abc' when 2 then repeat('0', 64) else DIGEST end as claimed_hash, text from documents where text is not null""",
    "playlists": """select user_id, entity_id as playlist_id, seq, concat('P', cast(track_id % 15 as STRING)) as name,
      case when track_id % 6 = 0 then concat('t', cast(user_id as STRING), '_', cast(track_id % 4 as STRING)) end as source_id, track_id % 11 = 0 as is_smart, operation = 'delete' as deleted,
      case when track_id % 5 = 0 then concat('h', cast(track_id as STRING)) end as image_hash, track_id % 10 = 0 as has_image from folded""",
    "mapped": """select user_id, playlist_id, seq, case when seq % 21 = 0 then 'broken' else concat('t', cast(user_id as STRING), '_', cast(seq % 4 as STRING)) end as target_item_id,
      case seq % 4 when 0 then content_hash when 2 then stored_hash else 'old' end as content_hash from hashed where seq % 3 = 0""",
    "items": """select u.user_id, concat('t', cast(u.user_id as STRING), '_', cast(n.i as STRING)) as item_id, concat('p', cast((u.user_id + n.i % 3) % 15 as STRING)) as name, s.stamp, concat('h', cast(5 * n.i as STRING)) as image
      from (select distinct user_id from playlists) u cross join (select 0 as i union all select 1 union all select 2 union all select 3) n
      left join (select user_id, target_item_id, min(playlist_id) as stamp from mapped where seq % 2 = 0 group by user_id, target_item_id) s
      on s.user_id = u.user_id and s.target_item_id = concat('t', cast(u.user_id as STRING), '_', cast(n.i as STRING))""",
}


def input_sql(name: str, text_type: str, digest: str = "") -> str:
    return INPUTS[name].replace("STRING", text_type).replace("DIGEST", digest)
