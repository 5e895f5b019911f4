"""Fixed values of the data contracts."""

TARGET_FPS = 20
FRAMES_PER_TOKEN = 4
CODEBOOK_SIZE = 256
SHARD_FRAMES = 250_000
WINDOW_FRAMES, WINDOW_STRIDE = 196, 64
STD_FLOOR = 1e-4
TIMELINE_TOLERANCE_S = 0.025
TRAIN_PERCENT, VAL_PERCENT = 90, 95
SPLIT_PRIORITY = {"train": 0, "val": 1, "test": 2}

#: Quality thresholds, in the order in which the gates are applied.
QUATERNION_NORM_TOLERANCE = 1e-3
DOF_LIMIT_TOLERANCE_RAD = 1e-3
MIN_HEIGHT_M, MAX_HEIGHT_M = 0.5, 2.5
MAX_BONE_LENGTH_CV = 0.02
MAX_JOINT_SPEED_M_S = 15.0
MAX_ROOT_SPEED_M_S = 5.0
MAX_ANGULAR_SPEED_RAD_S = 20.0
MAX_DOF_SPEED_RAD_S = 30.0
MIN_ENERGY_CORRELATION = -0.1
MAX_FOOT_PENETRATION_M = 0.05
NEAR_FLOOR_M = 0.06
STILL_STD = 1e-5

CONTACT_HEIGHT_M, CONTACT_SPEED_M_S, FLOOR_PERCENTILE = 0.06, 0.25, 0.02
HUMAN_WIDTH, G1_WIDTH = 262, 75
HUMAN_SCHEMA, G1_SCHEMA = "human_intergen_262_v1", "g1_canonical_75d_v2"
