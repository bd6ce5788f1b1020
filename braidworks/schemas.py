"""Declared schemas of the social tables, logs and traces; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


CREATOR = _struct(user_id=LongType(), username=StringType())
MEDIA = _struct(media_id=LongType(), media_type=StringType())
URL = _struct(shortened_url=StringType(), expanded_url=StringType())
MENTION = _struct(user_id=LongType(), username=StringType())

USERS = _struct(username=StringType(), user_id=LongType(), first_name=StringType(), last_name=StringType(), salt=StringType(), password_hashed=StringType())
FILES = _struct(filename=StringType(), data=BinaryType())
TIMELINE = _struct(user_id=LongType(), timestamp=LongType(), post_id=LongType())
EDGES = _struct(follower=LongType(), followee=LongType())
POST = _struct(
    post_id=LongType(), creator=CREATOR, req_id=LongType(), text=StringType(), user_mentions=ArrayType(MENTION),
    media=ArrayType(MEDIA), urls=ArrayType(URL), timestamp=LongType(), post_type=IntegerType(),
)
COMPOSE = _struct(
    req_id=LongType(), username=StringType(), user_id=LongType(), text=StringType(), media_ids=ArrayType(LongType()),
    media_types=ArrayType(StringType()), post_type=IntegerType(), timestamp=LongType(),
)
FANOUT_MESSAGE = _struct(user_id=LongType(), req_id=LongType(), post_id=LongType(), timestamp=LongType(), user_mentions_id=ArrayType(LongType()))
TRACE = _struct(absl_start_us=LongType(), start_us=LongType(), duration_us=LongType())
LOAD = _struct(task_id=LongType(), migratable=BooleanType(), mem_size=LongType(), cpu_load=FloatType())
NODE = _struct(ip=LongType(), isol=BooleanType(), acquired=BooleanType(), cores=FloatType(), mem_mbs=FloatType())

POST_TYPES = ["POST", "REPOST", "REPLY", "DM"]
EVENT_PROPS = _struct(k=StringType())
