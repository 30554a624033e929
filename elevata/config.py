"""Thresholds of the take-off rules.

Fixed values: they must equal those of the product whose reports are
reproduced.
"""

# HSV ranges (H 0-180) of the marking colours, by kind and name.
COLOUR_RANGES = {
    "facade": {"cyan": ((80, 45, 60), (105, 255, 255)), "blue": ((100, 45, 60), (130, 255, 255))},
    "window": {"yellow": ((18, 80, 80), (35, 255, 255)), "green": ((35, 60, 60), (85, 255, 255))},
    "door": {"orange": ((5, 100, 100), (20, 255, 255)), "magenta": ((140, 80, 80), (170, 255, 255))},
}
MIN_FACADE_AREA_PX, MIN_WINDOW_AREA_PX, MIN_DOOR_AREA_PX = 5000, 800, 800

# Scene classification.
GABLE_MAX_ASPECT, GABLE_TOP_SPAN, GABLE_TOP_IQR, GABLE_PEAK = 2.15, 0.28, 0.12, 0.10
FLAT_MIN_ASPECT, FLAT_TOP_IQR = 2.00, 0.10
COMPOSITE_MIN_OPENINGS, COMPOSITE_TOP_SPREAD, COMPOSITE_CENTRE_SPREAD = 4, 0.12, 0.16
BORDERLINE_TOP_SPAN, BORDERLINE_MAX_OPENINGS, SPARSE_MAX_OPENINGS = 0.08, 4, 1

# Plausible areas (m2) and sizes (m): (window, door, other).
AREA_BOUNDS = {"window": (0.15, 15.0), "door": (0.5, 6.5), "other": (0.01, 5000.0)}
WIDTH_BOUNDS = {"window": (0.2, 8.0), "door": (0.5, 5.0), "other": (0.05, 50.0)}
HEIGHT_BOUNDS = {"window": (0.2, 5.0), "door": (1.4, 5.0), "other": (0.05, 50.0)}
OCR_SIZE_BOUNDS = {"window": (0.2, 4.5), "door": (0.6, 3.5), "facade": (0.5, 100.0), "other": (0.2, 50.0)}
OCR_AREA_BOUNDS = {"window": (0.1, 15.0), "door": (0.5, 6.5), "facade": (1.0, 5000.0), "other": (0.05, 5000.0)}

# Distances in pixels.
TITLE_DISTANCE, FACADE_DISTANCE, WINDOW_DISTANCE, DOOR_DISTANCE, ELEMENT_DISTANCE = 500, 600, 220, 240, 80
SCALE_TOKEN_DISTANCE, METRIC_DISTANCE = 140, 80
#: A detected door without a sign of one counts up to here from a read door.
SIGNLESS_DOOR_DISTANCE = 90

# Grey level of the border from which a page counts as white, and the ratio
# that is assumed where none is read.
WHITE_BORDER, USUAL_RATIO = 240.0, 100

# Scale ratios that drawings use; inches in a metre; native page resolution.
COMMON_RATIOS = (20, 25, 50, 75, 100, 125, 200, 250)
INCHES_PER_METRE, PAGE_DPI = 39.37007874, 254

# Accuracy floors by class: facade, socle, window, door.
IOU_FLOORS = {"facade": 0.72, "socle": 0.45, "window": 0.40, "door": 0.45}

# Names of classes in label files, with their ids.
CLASS_IDS = {"facade": 0, "fatada": 0, "window": 1, "fereastra": 1, "door": 2, "usa": 2, "ușa": 2, "socle": 3, "soclu": 3}
