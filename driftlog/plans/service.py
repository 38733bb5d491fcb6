"""Queries of the push, payload, sharing, retention, blob and export operators, by name."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import log as L
from ..operators import projection as J
from ..operators import push as P
from ..operators import reconcile as R
from ..operators import sharing as H
from ..operators import upkeep as U
from ..sources import bodies as B
from ..sources import views as V
from ..sources.shared import kept
from .inputs import input_sql
from .queries import ACTIVE_DAYS, GRACE_DAYS, LIMIT, SINCE, Store, visible

MAX_OPS, MAX_UPLOAD, PAGE = 150, 20_000, 20
DAYS = U.retention_days(2, ACTIVE_DAYS)


class Service(Store):
    """The store with pushed batches, payloads, grants, uploads and a catalog beside it."""

    def read(self, name: str, **tables: DataFrame) -> DataFrame:
        """An input of ``inputs``; the tables it names are given, each built once."""
        known = {"ops": self.ops, "owners": self.owners} | tables
        text = input_sql(name, "string", "sha2(cast(text as binary), 256)").replace("{", "{{").replace("}", "}}")
        used = {k: v for k, v in known.items() if re.search(rf"(from|join) {k}\b", text)}
        for k in used:
            text = re.sub(rf"(from|join) {k}\b", rf"\1 {{{k}}}", text)
        return self.spark.sql(text, **used)

    @property
    def some_owners(self) -> DataFrame:
        return self.read("some_owners")

    @cached_property
    def push(self) -> P.Push:
        return P.Push(self.read("batch"), self.some_owners, self.shares, max_ops=MAX_OPS)

    @cached_property
    def push_on_log(self) -> P.Push:
        """The push on a log that holds every sixth accepted operation already."""
        self.push.log = kept(self.push.accepted.where("turn % 6 = 0").select("user_id", "op_id", F.col("turn").alias("seq"), "entity", "entity_id"))
        return self.push

    @cached_property
    def hashed(self) -> DataFrame:
        folded = kept(L.state(self.ops.where("entity in ('playlists', 'playlist_items')")))
        lists = self.read("playlists", folded=folded.where("entity = 'playlists'"))
        listed = lists.join(L.members_of(folded), ["user_id", "playlist_id"], "left").withColumn("tracks", F.coalesce("tracks", F.array().cast("array<bigint>")))
        catalog = V.table(self.spark, self.sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("track_id"))
        return kept(R.hashed(R.resolved(listed, catalog), lists.where("has_image").select("user_id", "image_hash")))

    @cached_property
    def mapping(self) -> DataFrame:
        """What the last export recorded."""
        return kept(self.read("mapped", hashed=self.hashed))

    @cached_property
    def items(self) -> DataFrame:
        return kept(self.read("items", playlists=self.hashed, mapped=self.mapping))

    @cached_property
    def actions(self) -> DataFrame:
        return kept(R.plan(self.hashed, self.mapping, self.items, lambda item: item.rlike("^t[0-9]+_[0-9]+$")))

    @cached_property
    def artworks(self) -> DataFrame:
        return kept(R.artwork(self.hashed, self.actions, self.items))

    def uploads(self) -> DataFrame:
        rows = self.read("uploads", documents=V.table(self.spark, self.sf_dir, "documents")).withColumn("bytes", F.col("text").cast("binary"))
        return U.uploads_judged(rows, MAX_UPLOAD)

    @cached_property
    def share_requests(self) -> DataFrame:
        users = V.table(self.spark, self.sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
        return kept(H.judged(self.read("share_events"), self.owners, users))

    def some_blobs(self) -> DataFrame:
        return V.blobs(self.spark, self.sf_dir).where("size % 3 = 0")


def payload_fields(s: Service) -> DataFrame:
    p = F.col("payload")
    return s.read("payloads").select(
        "seq",
        C.read_string(C.found(p, "name")).alias("name"),
        C.is_deleted(F.col("operation"), p).alias("deleted"),
        C.stamp(p, F.col("created_at")).alias("stamp"),
        C.playlist_of(F.col("entity"), F.col("entity_id"), p).alias("routed"),
    )


def body_lines(s: Service) -> DataFrame:
    """The log's operations in requests of fifty, as texts: broken off, nested too deep, without operations, of the wrong kind, oddly spelled."""
    text = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    names = {name: F.when(F.col("batch_id") % 10 == 6, F.lit(name.upper())).otherwise(F.lit(name)) for name in ("opId", "entity", "entityId", "operation", "payload", "createdAt")}
    at = F.when(F.col("batch_id") % 10 == 6, F.concat(F.lit('"'), F.col("created_at"), F.lit('"'))).otherwise(F.col("created_at").cast("string"))
    payload = F.when(F.col("entity") == "playlist_items", F.concat(F.lit('{ "playlistId" : "'), F.col("playlist_id"), F.lit('",  "n":1.50, "m": [ ] }'))).otherwise(F.col("payload"))
    values = {"opId": text("op_id"), "entity": text("entity"), "entityId": text("entity_id"), "operation": text("operation"), "payload": payload, "createdAt": at}
    op = F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit('"'), names[n], F.lit('":'), v) for n, v in values.items())), F.lit("}"))
    rows = s.ops.withColumn("batch_id", F.floor(F.col("seq") / 50))
    listed = rows.groupBy("batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", op.alias("op")))), lambda x: x["op"]), ",").alias("ops"))
    kind, whole = F.col("batch_id") % 10, F.concat(F.lit('{"deviceId":"d","ops":['), F.col("ops"), F.lit("]}"))
    return listed.select(
        "batch_id",
        F.when(kind == 0, F.substring(whole, 1, 40))
        .when(kind == 1, F.concat(F.lit('{"x":' + "[" * 128 + "]" * 128 + ","), F.substring(whole, 2, 1 << 30)))
        .when(kind == 2, '{"deviceId":"d","ops":null}')
        .when(kind == 3, F.concat(F.lit("["), whole, F.lit("]")))
        .when(kind == 4, F.concat(F.lit('{"ops":[{"opId":5},'), F.col("ops"), F.lit("]}")))
        .when(kind == 5, F.concat(F.lit('{"ops":[],"DEVICEID" : "e", "Ops":[null,'), F.col("ops"), F.lit("]}")))
        .otherwise(whole)
        .alias("body"),
    )


def body_push(s: Service) -> DataFrame:
    """From bodies to the verdict on each operation, in one chain: each request is another user's."""
    rows = B.operations(B.requests(body_lines(s))).withColumns({"user_id": F.col("batch_id") % 7, "turn": F.col("batch_id") * 1000 + F.col("nth"), "received_at": F.lit(V.NOW_MS)})
    return P.Push(rows, s.some_owners, s.shares, max_ops=MAX_OPS).judged.select("batch_id", "nth", "playlist_id", "reason")


def projected(s: Service) -> DataFrame:
    return J.projected(s.read("described")).withColumn("tracks", F.array_join("tracks", ","))


def device_pages(s: Service) -> tuple[DataFrame, DataFrame]:
    """The page of every device of every user after its cursor, a third of them far behind, and the cursors it came with."""
    behind = kept(s.cursors.select("user_id", "device_id", F.when(F.col("cursor") % 3 == 0, F.col("cursor") % 50).otherwise(F.col("cursor") - F.col("cursor") % 400).alias("cursor")))
    owners = kept(s.owners)
    return J.pages(s.ops, behind, owners, V.shares(owners), PAGE, block=1000), behind


def targets(s: Service) -> DataFrame:
    """What each batch touches: its playlists and its queue devices, each once."""
    rows = s.read("batch")
    lists = rows.where("playlist_id is not null").select("batch_id", F.lit("playlist").alias("kind"), F.col("playlist_id").alias("target"))
    return lists.unionByName(rows.where("entity = 'queue_state'").select("batch_id", F.lit("queue").alias("kind"), F.col("entity_id").alias("target"))).distinct()


def guids(s: Service) -> DataFrame:
    """Users' ids in all forms, two of them broken."""
    digits, which = F.lpad(F.lower(F.hex("user_id")), 8, "0"), F.col("user_id") % 8
    dashed = F.concat(F.upper(digits), F.lit("-0000-4000-8000-00000000000A"))
    around = lambda a, b: F.concat(F.lit(a), dashed, F.lit(b))
    forms = [around("{", "}"), F.lit("nobody"), around("(", ")"), F.lpad(F.lower(F.hex("user_id")), 32, "0"), around("{", ")"), F.concat(digits, F.lit("-00-004000800000000000000A"))]
    forms += [F.concat(F.lit("{0x"), F.lower(F.hex("user_id")), F.lit(",0x0,0x4000,{0x80,0x00,0x0,0x0,0x0,0x0,0x0,0xA}}")), around(" ", "\t")]
    raw = F.get(F.array(*forms), which.cast("int"))
    return s.ops.select(C.guid(raw).alias("user_id")).where("user_id is not null").distinct()


def lookups(s: Service) -> DataFrame:
    """Whether named blobs exist, and their sizes: the first byte tells which are asked for in upper case, which no lower-case blob answers."""
    blobs = V.blobs(s.spark, s.sf_dir)
    asked = blobs.select("user_id", F.when(F.col("image_hash") < "8", F.upper("image_hash")).otherwise(F.col("image_hash")).alias("image_hash"))
    return asked.join(blobs.withColumn("found", F.lit(True)), ["user_id", "image_hash"], "left").select("user_id", "image_hash", F.coalesce("found", F.lit(False)).alias("found"), "size")


def named_shares(s: Service) -> DataFrame:
    users = V.table(s.spark, s.sf_dir, "customer").select(F.col("c_custkey").alias("grantee_user_id"), F.col("c_name").alias("user_name"))
    return s.shares.join(users, "grantee_user_id", "left").select("playlist_id", "grantee_user_id", "user_name")


def status(s: Service) -> DataFrame:
    return s.ops.agg(F.max("seq").alias("head"), F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def pull_cursor(s: Service) -> DataFrame:
    """The viewer's device cursor after the page has been sent."""
    return L.page_meta(visible(s), SINCE, LIMIT).select("cursor")


BUILD = {
    "batch_gate": lambda s: P.gated(s.read("batch"), MAX_OPS),
    "push_accepted": lambda s: s.push.accepted.select("batch_id", "turn"),
    "push_rejected": lambda s: s.push.judged.where("reason is not null").select("batch_id", "turn", "reason"),
    "assign_seq": lambda s: s.push_on_log.appended.select("user_id", "op_id", "seq"),
    "push_head": lambda s: s.push_on_log.heads,
    "push_owners": lambda s: s.push.owners_now.select("playlist_id", "owner_user_id"),
    "push_superfluous": lambda s: s.push_on_log.superfluous,
    "batch_targets": targets,
    "projected_playlists": projected,
    "routed_anew": lambda s: J.routed_anew(s.read("described")).select("seq", "playlist_id"),
    "owners_anew": lambda s: J.owners_anew(J.routed_anew(s.read("described"))),
    "device_pages": lambda s: device_pages(s)[0],
    "device_cursors_pulled": lambda s: J.cursors_of(*device_pages(s), PAGE),
    "body_ops": lambda s: B.operations(B.requests(body_lines(s))).select("batch_id", "nth", "device_id", "op_id", "entity_id", "payload", "created_at"),
    "body_refused": lambda s: B.requests(body_lines(s)).select("batch_id", "refused"),
    "body_push": body_push,
    "payload_fields": payload_fields,
    "playlist_id_of": lambda s: payload_fields(s).where("routed is not null").groupBy("routed").agg(F.count("*").alias("n")),
    "pull_limit": lambda s: s.ops.select("seq", C.clamped(F.when(F.col("track_id") % 7 > 0, F.col("track_id") - 20), 50, 1, 60).cast("long").alias("page"), F.greatest(F.coalesce(F.when(F.col("track_id") % 3 > 0, F.col("track_id")), F.lit(30)), F.lit(30)).cast("long").alias("days")),
    "pull_cursor_event": pull_cursor,
    "guid_users": guids,
    "storage_status": status,
    "device_cursor_upsert": lambda s: U.cursors_after(s.cursors, s.read("pulls")),
    "share_upsert": lambda s: U.shares_after(s.shares, s.read("grants", shares=s.shares)),
    "share_revoke": lambda s: U.revoked(s.shares, s.read("revokes", shares=s.shares))[1],
    "shares_left": lambda s: U.revoked(s.shares, s.read("revokes", shares=s.shares))[0].select("playlist_id", "grantee_user_id", "can_edit"),
    "share_names": named_shares,
    "share_verdicts": lambda s: H.verdicts(s.share_requests, s.shares),
    "shares_after_requests": lambda s: H.after(s.share_requests, s.shares),
    "retention_report": lambda s: U.retention_report(s.ops, s.cursors, V.NOW_MS, DAYS),
    "retention_survivors": lambda s: U.retention(s.ops, s.cursors, V.NOW_MS, DAYS).where("not prunable").select("seq", "user_id"),
    "queue_listing": lambda s: U.queue_listing(L.latest(s.ops.where("entity = 'queue_state'").select("user_id", "entity_id", "seq", "received_at"), ["user_id", "entity_id"], F.col("seq")), "d1", V.NOW_MS),
    "blob_integrity": lambda s: s.uploads().select("user_id", "turn", "mime", "reason"),
    "blob_upload": lambda s: U.blobs_after(s.some_blobs(), s.uploads()),
    "blob_list": lambda s: U.orphans_listed(s.orphans.withColumns({"orphan": F.lit(True)})).select("user_id", "image_hash", "size", "nth"),
    "blob_lookup": lookups,
    "orphan_listing": lambda s: U.orphans_listed(s.orphans).select("user_id", "image_hash", "age_days", "nth"),
    "reclaim_report": lambda s: U.reclaim_report(s.orphans),
    "resolved_tracks": lambda s: s.hashed.select("user_id", "playlist_id", F.array_join("resolved", ",").alias("resolved"), "unresolved", "artwork_missing", "content_hash"),
    "export_map": lambda s: s.mapping.select("user_id", "playlist_id", "target_item_id", "content_hash"),
    "export_plan": lambda s: s.actions,
    "adopt_targets": lambda s: s.actions.where("action = 'adopted'").select("user_id", "playlist_id", "target_item_id"),
    "export_artwork": lambda s: s.artworks,
    "export_report": lambda s: R.report(s.actions, s.hashed, s.artworks),
    "export_map_upsert": lambda s: R.mapping_after(s.mapping, s.actions),
}
QUERIES = {name: (lambda spark, sf_dir, build=build: build(Service(spark, sf_dir))) for name, build in BUILD.items()}
