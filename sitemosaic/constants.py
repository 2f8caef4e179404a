"""Fixed values of the estimator definitions. They decide results; do not tune."""
import math

# --- fixed values -----------------------------------------------------------
PROPENSITY_CLIP = (0.01, 0.99)
KNOWN_PROPENSITY_CLIP = (0.1, 0.9)
OUTCOME_CLIP = (0.001, 0.999)
DR_WEIGHT_CLIP = (0.1, 10.0)
TILT_GUARD = (1e-10, 1e10)
RATIO_CLIP = (1e-10, 1e6)
VARIANCE_FLOOR = 1e-6
EPSILON = 1e-8
RADIUS = 5.0
LOGISTIC_CLIP = 50.0
OUTER_FOLDS = 10
CV_FOLDS = 5
CV_FOLDS_MIN = 4
LAMBDA_GRID_SIZE = 100
LAMBDA_RATIO_TALL = 1e-4
LAMBDA_RATIO_WIDE = 0.01
LAMBDA_FLOOR = 1e-6
WALD_LAMBDA = 1.0
QUADRATIC_BIAS_POWER = 0.75
BOOTSTRAP_REPLICATES = 5000
WEIGHT_BOOTSTRAP_REPLICATES = 500
Z_975 = 1.959963984540054
MIN_ARM_FOR_FIT = 5
MIN_CLASS_FOR_FIT = 8
SOLVER_MAX_ITER = 10_000
SOLVER_TOL = 1e-6
WEIGHT_TOL = 1e-8
RIDGE = 1e-6
LOG_SMALLEST_NORMAL = math.log(2.2250738585072014e-308)
TARGET = "t"
# ----------------------------------------------------------------------------
