"""Values that define behaviour, in one place.

The following are fixed values: results equal the reference's only with them as they are.
"""

# Plate templates: L a letter, D a digit; the one without a series scores less.
TEMPLATES = ("LLDDLDDDD", "LLDDLLDDDD", "LLDLDDDD", "LLDLLDDDD", "LLDDDDDD", "LLDDLDDD")
WEAK_TEMPLATE, WEAK_SCORE, FULL_SCORE = "LLDDDDDD", 0.70, 1.0
# Literal layouts that a person has to review.
REVIEW_LAYOUT = "^[A-Z]{2}([0-9]{1,2}[A-Z]{1,3}[0-9]{1,4}|[0-9]{3,6})$"
PLAUSIBLE, DIGIT = "^[A-Z]{2}[A-Z0-9]{3,12}$", "[0-9]"
# Letters read for digits.
CONFUSED = {"O": "0", "I": "1", "Z": "2", "S": "5", "B": "8", "G": "6", "Q": "0", "D": "0", "T": "7"}
SUBSTITUTION_COST = LITERAL_MARGIN = OMISSION_COST = AMBIGUITY_MARGIN = 0.08
LONGEST_SPAN, SHORT_REGION = 14, 4
SELECT_CONFIDENCE, SELECT_SCORE, SELECT_FORMAT = 0.80, 0.75, 0.84
UNSUPPORTED_FACTOR = 0.4
STRONG_CONFIDENCE, STRONG_MARGIN = 0.95, 0.15
ROW_OVERLAP = 0.5
GATE = 0.90
FUSE_AGREEMENT, FUSE_ACCEPT, FUSE_FORMAT, FUSE_SINGLE, FUSE_CAP, FUSE_BONUS, FUSE_BONUS_FRAMES = 2, 0.88, 0.85, 0.92, 0.99, 0.03, 4
FUSE_FLOOR, FUSE_FORMAT_WEIGHT, FUSE_SHARP_WEIGHT, RESCUE_DIFFERENCES = 0.01, 0.5, 0.1, 2
CONTAINED, VEHICLE_CONFIDENCE, FIRST_CONTAINED = 0.9, 0.5, 0.85
IOU = 0.5
VEHICLE_TYPES, VEHICLE_DETECTION = ("car", "motorcycle", "bus", "truck", "other"), 0.35
NEAR_BITS = 4
VAL_SHARE, TEST_SHARE, SEED = 0.15, 0.15, 42
GROUP_CAP, CAP_SALT = 20, "balanced-sampling-v1:"
CONDITIONS, SEVERITIES = ("haze", "rain", "blur", "lowlight"), ("mild", "moderate", "severe")
PAD_SHARE, PAD_LEAST = 0.04, 2
FRAMES_PER_TRACK = 5
ROUTE_CONDITION, ROUTE_SEVERITY = 0.55, 0.5
OUTCOMES = ("correct_accepted", "wrong_accepted", "correct_uncertain", "wrong_uncertain", "unreadable")
