"""Queries of the preparation job over pairs made of events, each beside the SQL that states its result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.functions.kernels import BodyTree
from strideflow.operators import frames, tracks
from strideflow.plans.kernels import _joints
from strideflow.plans.motion import SQL_FRAMES
from strideflow.sources.shared import materialise
from strideflow.sources.tables import event_frames

CATALOGUE: dict[str, tuple] = {}
DOF = tuple(f"j{k}" for k in range(29))
LIMITS = [(-3.0, 3.0)] * len(DOF)

#: v: values; d: change of the human's place and of the robot's, the latter half a step of its 10 a second; p: points of the common grid.
_PAIRS = f"""WITH {SQL_FRAMES.strip()}, l AS (SELECT sample_id, sample_id % 8 AS kind, list(value::DOUBLE ORDER BY t) AS v, count(*) AS n, count(*) - 1 + count(*) % 2 AS p FROM f GROUP BY 1),
    h AS (SELECT sample_id, max(abs(0.01 + 0.0002 * CASE WHEN kind = 3 THEN 20 ELSE 1 END * (v[k + 1] - v[k]))) * 20 AS raw_speed FROM (SELECT *, unnest(generate_series(1, n - 1)) AS k FROM l) GROUP BY 1),
    g AS (SELECT sample_id, kind, p, k, 0.01 + 0.0002 * CASE WHEN kind = 3 THEN 20 ELSE 1 END * (v[k + 1] - v[k]) AS human, 0.05 * (k - 1) AS yaw,
        (0.02 + 0.0001 * (v[(k - 1) // 2 * 2 + 3] - v[(k - 1) // 2 * 2 + 1])) / 2 AS robot, abs(0.05 * (sin(v[(k - 1) // 2 * 2 + 3]) - sin(v[(k - 1) // 2 * 2 + 1]))) * 10 AS dof
        FROM (SELECT *, unnest(generate_series(1, p - 1)) AS k FROM l)),
    s AS (SELECT sample_id, k, 20 * sqrt((robot - o * (sin(yaw + 0.05) - sin(yaw))) ** 2 + (o * (cos(yaw + 0.05) - cos(yaw))) ** 2) AS slide FROM g, (SELECT unnest([0.1, -0.1]) AS o)),
    q AS (SELECT sample_id, quantile_cont(slide, 0.95) AS slide, count_if(slide <= 0.25) + 2 AS contacts FROM s GROUP BY 1),
    m AS (SELECT sample_id, any_value(kind) AS kind, any_value(p) AS p, max(abs(human)) * 20 AS joint_speed, max(abs(robot)) * 20 AS root_speed, max(dof) AS dof_speed,
        CASE WHEN stddev_pop(abs(human) * 20) > 1e-5 AND stddev_pop(dof) > 1e-5 THEN corr(abs(human), dof) ELSE 1 END AS energy, sum(human) + arg_max(human, k) AS path, 4 * (count_if(human ** 2 < 0.002) + arg_max((human ** 2 < 0.002)::INT, k)) AS still,
        sum(robot) AS ahead, 20 * sum(robot * cos(yaw)) AS along, 20 * sum(robot * sin(yaw)) AS aside FROM g GROUP BY 1),
    r AS (SELECT *, CASE WHEN kind = 7 THEN 'g1_quaternion_norm' WHEN kind = 4 THEN 'g1_dof_limit' WHEN kind = 1 THEN 'human_height' WHEN kind = 2 THEN 'human_bone_length' WHEN raw_speed > 15 THEN 'human_joint_speed'
        WHEN root_speed > 5 THEN 'g1_root_speed' WHEN energy < -0.1 THEN 'pair_energy_alignment' WHEN kind = 6 THEN 'g1_foot_penetration' END AS reason FROM m JOIN h USING (sample_id) JOIN q USING (sample_id))"""


def query(sql: str):
    def add(f):
        CATALOGUE[f.__name__] = (f, _PAIRS + sql)
        return f

    return add


def robot() -> BodyTree:
    """A pelvis with two ankles below it; the other joints move nothing that is measured."""
    ankles = "".join(f'<body name="{side}_ankle_roll_link" pos="0 {y} -0.78"><joint name="j{k}" axis="0 1 0"/></body>' for k, (side, y) in enumerate((("left", 0.1), ("right", -0.1))))
    others = "".join(f'<body name="b{k}"><joint name="j{k}"/></body>' for k in range(2, len(DOF)))
    return BodyTree.parse(f'<m><worldbody><body name="pelvis">{ankles}{others}</body></worldbody></m>', DOF)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """A pair for each user: a human that walks by the events at 20 frames a second, a robot that follows every second event at 10 a second. One of eight kinds of users each breaks another gate."""
    s = frames.sequence_arrays(event_frames(spark, d), "value").withColumn("kind", F.col("sample_id") % 8)
    s = s.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("sample_id"))  # a given number is not coalesced: the rows are small, the work on them is not; by the key itself Spark would leave it out
    kind = F.col("kind")
    skeleton = _joints(np.zeros(1))[0][:, [0, 2, 1]] * (1, -1, 1)
    base = F.array(*[F.lit(float(x)) for x in skeleton.ravel()])
    pace = F.when(kind == 3, 0.004).otherwise(0.0002)

    def human(v: Column, t: Column) -> Column:
        moved = lambda x, i: x + F.when(i % 3 == 0, t * 0.01 + v * pace).otherwise(0.0) + F.when((kind == 2) & (i == 46) & (t % 2 == 1), 0.03).otherwise(0.0)
        return F.transform(base, lambda x, i: moved(x, i) * F.when(kind == 1, 1.5).otherwise(1.0))

    slow = F.filter("values", lambda _, t: t % 2 == 0)
    long = F.when(kind == 7, 1.1).otherwise(1.0)
    flat = lambda values, make: F.flatten(F.transform(values, make))
    return s.select(
        F.col("sample_id").cast("string").alias("sample_id"), flat("values", human).alias("human"), F.lit(20.0).alias("human_fps"),
        flat(slow, lambda v, j: F.array(j * 0.02 + v * 0.0001, F.lit(0.0), F.when(kind == 6, 0.7).otherwise(0.8))).alias("root"),
        flat(slow, lambda _, j: F.array(F.lit(0.0), F.lit(0.0), F.sin(j * 0.05) * long, F.cos(j * 0.05) * long)).alias("rotation"),
        flat(slow, lambda v, j: F.transform(F.sequence(F.lit(0), F.lit(len(DOF) - 1)), lambda c: F.sin(v) * 0.05 + c * 0.001 + F.when((kind == 4) & (j == 3), 4.0).otherwise(0.0))).alias("dof"), F.lit(10.0).alias("robot_fps"),
    )


@query("""
    SELECT sample_id::VARCHAR AS sample_id, reason, CASE WHEN reason IS NULL THEN p END AS frames, CASE WHEN reason IS NULL THEN round(joint_speed, 5) END AS joint_speed, CASE WHEN reason IS NULL THEN round(root_speed, 5) END AS root_speed,
        CASE WHEN reason IS NULL THEN 1.0::DOUBLE END AS angular_speed, CASE WHEN reason IS NULL THEN round(dof_speed, 5) END AS dof_speed, CASE WHEN reason IS NULL THEN round(energy, 4) END AS energy, CASE WHEN reason IS NULL THEN 0.02::DOUBLE END AS floor_y,
        CASE WHEN reason IS NULL THEN round(slide, 5) END AS slide FROM r""")
def track_records(spark, d):
    """Every pair's reason, or its measures on the common grid."""
    records, _ = tracks.prepare(materialise(pairs(spark, d), "pairs"), LIMITS, robot())
    named = {"max_joint_speed": "joint_speed", "max_root_speed": "root_speed", "max_dof_speed": "dof_speed", "near_floor_slide": "slide", "max_angular_speed": "angular_speed", "floor_y": "floor_y"}
    return records.select("sample_id", "reason", "frames", F.round("energy_correlation", 4).alias("energy"), *[F.round(k, 5).alias(v) for k, v in named.items()])


@query("""
    SELECT sample_id::VARCHAR AS sample_id, p AS frames, round(path, 3) AS path, still::BIGINT AS still, round(ahead, 3) AS ahead, round(along, 2) AS along, round(aside, 2) AS aside, (p - 1)::DOUBLE AS turned, contacts::BIGINT AS contacts FROM r WHERE reason IS NULL""")
def track_features(spark, d):
    """Sums over the features of every accepted pair: the human's path and still feet, the robot's way ahead, local velocities, turning and contacts."""
    _, f = tracks.prepare(materialise(pairs(spark, d), "pairs"), LIMITS, robot())
    of = lambda side, k: F.sum(F.get(side, F.lit(k)).cast("double"))
    still = sum((of("human", k) for k in range(259, 262)), of("human", 258))
    return f.groupBy("sample_id").agg(
        F.count("*").alias("frames"), F.round(of("human", 66), 3).alias("path"), still.cast("long").alias("still"), F.round(F.max_by(F.get("robot", F.lit(2)).cast("double"), "t"), 3).alias("ahead"), F.round(of("robot", 38), 2).alias("along"),
        F.round(of("robot", 40), 2).alias("aside"), F.round(of("robot", 42), 2).alias("turned"), (of("robot", 73) + of("robot", 74)).cast("long").alias("contacts"),
    )
