"""Fixed values of the rule tables.

Everything in this module is data: labels, substrings, texts and numbers that
results must reproduce exactly.  List order is meaning (the first matching
entry wins), and substring tests are case-sensitive, so "spoiler" is an oil
complaint and "incident" a dent.  Do not sort or tidy these lists.
"""

# --- fixed values: complaint text -> issue label, first match wins -----------
UNCATEGORISED = "Uncategorised - Review Needed"

ISSUE_RULES = [
    ("Infotainment System", ["infotainment", "touchscreen", "Infotainment"]),
    ("Bluetooth Connectivity", ["Bluetooth", "bluetooth"]),
    ("ADAS / Safety Systems", ["ADAS", "collision", "lane departure", "emergency braking"]),
    ("Parking Aids & Camera", ["camera", "parking sensor", "radar"]),
    ("Climate Control / AC", ["AC", "air condition", "climate", "cooling"]),
    ("Charging & Connectivity Ports", ["USB", "charging", "wireless"]),
    ("Software / Navigation", ["GPS", "navigation", "OTA"]),
    ("Engine Cold Start & Idle Stability", ["engine stall", "Engine stall", "cutting out"]),
    ("Engine NVH (Noise / Vibration)", ["engine noise", "Engine noise", "vibration", "humming"]),
    ("Engine Oil Consumption & Leaks", ["oil", "Oil"]),
    ("Brake System & ABS", ["brake", "Brake", "ABS"]),
    ("Suspension & Steering", ["suspension", "Suspension", "clunk", "steering"]),
    ("Transmission & Drivetrain", ["gearbox", "gear", "clutch", "drivetrain"]),
    ("Fuel System", ["fuel", "Fuel"]),
    ("Paint & Surface Finish", ["paint", "Paint", "rust", "colour mismatch"]),
    ("Body Damage (Dents / Scratches)", ["dent", "scratch", "kerb rash"]),
    ("Interior Trim & Fittings", ["trim", "Trim", "rattle", "roof lining"]),
    ("Exterior Fittings & Lamps", ["headlight", "condensation", "spoiler", "mirror"]),
    ("Seat Condition & Adjustment", ["seat", "Seat"]),
    ("Windshield & Wipers", ["windshield", "wiper", "washer"]),
    ("Tyre & Wheel Condition", ["tyre", "Tyre", "wheel", "Wheel"]),
    ("Sunroof & Seals", ["sunroof", "wind noise"]),
    ("Door Seals & Weather Strips", ["door seal", "Door seal"]),
    ("Service Process / Scheduling", ["service", "Service", "warranty", "appointment"]),
    ("Fuel Efficiency Advisory", ["fuel efficiency", "kmpl"]),
    ("Recall / Software Update Notification", ["recall", "ECU", "software"]),
]

# --- fixed values: (result, category, substrings); no substrings = any text --
CHECKLIST_ITEM_RULES = [
    ("Brakes & Suspension", "Mechanical",
     ["brake", "Brake", "ABS", "suspension", "Suspension", "steering"]),
    ("Engine & Powertrain", "Mechanical", []),
    ("Electrical & Infotainment", "Electrical", []),
    ("Interior & Comfort", "Cosmetic", ["seat", "trim", "Trim", "dashboard", "roof lining"]),
    ("Exterior & Body", "Cosmetic", []),
]

COVERED = "COVERED by mapped checklist item - but inspection may have been superficial"

COVERAGE_RULES = [
    ("NOT COVERED - No checklist item exists for Service/Process complaints", "Service", []),
    ("NOT COVERED - Engine & Powertrain checklist lacks oil consumption test",
     "Mechanical", ["oil consumption"]),
    ("NOT COVERED - Engine & Powertrain checklist lacks gearbox shift quality test",
     "Mechanical", ["gear"]),
    ("NOT COVERED - Electrical checklist lacks ADAS calibration verification",
     "Electrical", ["ADAS", "collision", "lane departure"]),
    ("NOT COVERED - Electrical checklist lacks software/OTA update verification",
     "Electrical", ["OTA"]),
    ("NOT COVERED - Exterior checklist lacks rust/corrosion inspection", "Cosmetic", ["rust"]),
    ("NOT COVERED - Exterior checklist lacks headlight moisture/seal check",
     "Cosmetic", ["condensation"]),
]

# --- fixed values: issue label -> action text --------------------------------
DEFAULT_ISSUE_ACTION = "Define specific test procedure based on complaint descriptions"

ISSUE_ACTIONS = {
    "ADAS / Safety Systems": "Add: ADAS calibration test - 200m straight drive, verify zero false triggers on collision/lane alerts",
    "Infotainment System": "Add: Full reboot test - system must fully load within 30s, all menus responsive",
    "Bluetooth Connectivity": "Add: Bluetooth pairing + 5-min audio stream test before delivery sign-off",
    "Climate Control / AC": "Add: AC performance test - cabin must reach 20C within 10 min at 35C ambient",
    "Parking Aids & Camera": "Add: Reverse camera visual clarity check + all parking sensor beep test (front + rear)",
    "Software / Navigation": "Add: OTA firmware version check - confirm latest release installed, GPS lock within 60s",
    "Charging & Connectivity Ports": "Add: All USB ports and wireless pad functional test - charge indicator must show on device",
    "Engine Cold Start & Idle Stability": "Add: Cold start test - engine must idle stable for 5 min, no stall, no rough idle flag",
    "Engine Oil Consumption & Leaks": "Add: Oil level marker check + underside visual inspection for leaks before delivery",
    "Engine NVH (Noise / Vibration)": "Enhance Engine & Powertrain: Add 60 kmph road test - NVH must be within acceptable band",
    "Brake System & ABS": "Enhance Brakes: Add pedal feel test (firm, not spongy) + ABS warning light must be off at ignition",
    "Suspension & Steering": "Enhance Brakes & Suspension: Add kerb bump test at 20 kmph - zero clunk tolerance",
    "Transmission & Drivetrain": "Add: Gear shift quality test - all gears 1 to 6 in moving vehicle, smooth transition required",
    "Paint & Surface Finish": "Enhance Exterior & Body: Add rust spot scan under lamp + colour panel uniformity check in daylight",
    "Body Damage (Dents / Scratches)": "Enhance Exterior & Body: Mandatory 4-panel + roof photographic record before customer handover",
    "Interior Trim & Fittings": "Enhance Interior & Comfort: Add trim pull test (no loose panels) + rattle drive on rough surface",
    "Tyre & Wheel Condition": "Add: All 4 TPMS sensor readings must match gauge pressure, kerb rash check on all rims",
    "Windshield & Wipers": "Add: Wiper blade streak test (both speeds) + washer fluid spray direction check",
    "Sunroof & Seals": "Add: Sunroof water seal test + highway wind noise check at 80 kmph",
    "Service Process / Scheduling": "Process Gap: Mandatory service handover briefing - show customer portal, explain intervals, warranty terms, sign-off sheet",
    "Fuel Efficiency Advisory": "Process Gap: Add real-world vs ARAI fuel efficiency expectation card to delivery kit",
    "Recall / Software Update Notification": "Process Gap: VIN recall check mandatory before delivery; customer signs recall status acknowledgement",
    "Exterior Fittings & Lamps": "Add: Headlight condensation check + all exterior clips/fittings torque verified",
    "Door Seals & Weather Strips": "Add: Door seal compression check all 4 doors - no daylight gap, no wind noise at 80 kmph",
    "Seat Condition & Adjustment": "Enhance Interior & Comfort: All seat adjustment motors functional + fabric condition check",
    "Fuel System": "Add: Fuel filler cap seal check + no fuel smell inside cabin test",
}

# --- fixed values: gap severity, (minimum complaints, severity, action) ------
GAP_SEVERITY = [
    (15, "Critical", "Mandatory - add to ePDI checklist immediately"),
    (8, "High", "Recommended - schedule for next ePDI revision"),
    (4, "Medium", "Optional - monitor for 30 days"),
    (0, "Low", "Watchlist - insufficient data"),
]

# --- fixed values: recommendation status, most urgent first ------------------
STATUS_NOT_COVERED = "NOT COVERED - Add new checklist item"
STATUS_NOT_CATCHING = "COVERED BUT NOT CATCHING DEFECTS - Enhance test depth"
STATUS_NOT_ENFORCED = (
    "COVERED - But vehicles delivered with known defects - enforce pass/fail gate"
)
STATUS_MONITOR = "MONITOR"

# --- fixed values: risk scoring ----------------------------------------------
RISKY_CONDITIONS = ["Damage", "Signature Withheld"]
WORN_CONDITIONS = ["Fair", "Poor"]
HIGH_RISK_DEALERS = ["DLR-003", "DLR-002", "DLR-004"]
ENGINE_ITEM = "Engine & Powertrain"
BRAKE_ITEM = "Brakes & Suspension"
ELECTRICAL_ITEM = "Electrical & Infotainment"

# (item, penalty, factor text) in the order penalties are added
CRITICAL_ITEMS = [
    (ENGINE_ITEM, 0.16, "Engine/Powertrain fault — high recurrence risk"),
    (BRAKE_ITEM, 0.14, "Brakes/Suspension fault — safety-critical"),
    (ELECTRICAL_ITEM, 0.06, "Electrical fault — known software recurrence"),
]

# --- fixed values: defect score, SQL form: (fails, at least, critical, score), first match wins;
# critical None means either
SCORE_BASE = [
    (0, False, None, "0.05"),
    (1, False, False, "0.22"),
    (1, False, True, "0.38"),
    (2, False, False, "0.44"),
    (2, False, True, "0.60"),
    (3, True, True, "0.82"),
    (3, True, None, "0.68"),
]
SCORE_OTHERWISE = "0.10"
SCORE_ELECTRICAL, SCORE_DEALER, SCORE_CONDITION = "0.06", "0.08", "0.06"
SCORE_CAP = "0.97"

# --- fixed values: texts of the model scorer's factors ------------------------
FACTOR_ONE_FAIL = "1 inspection item failed"
FACTOR_TWO_FAILS = "2 inspection items failed"
FACTOR_MORE_FAILS = " inspection items failed — above safe threshold"
FACTOR_DEALER = ("Dealer ", " — elevated historical complaint rate")
FACTOR_CONDITION = "Vehicle delivery condition: "

# --- fixed values: texts of the delivery decision -----------------------------
HOLD_RECURRENCE = ("HOLD DELIVERY — Recurrence risk detected in ",
                   " item(s). Same fixes applied before led to complaints in ", "% of cases.")
CLEAR = "Clear for delivery"
FIX_FIRST = "Quick fixes required before delivery"
HOLD_FAILED = "Hold delivery — critical failures detected"

# --- fixed values: inspection form -------------------------------------------
CHECKLIST_KEYS = [
    "exterior_body", "paint_finish", "engine_bay", "ac_system", "brakes",
    "electrical", "tyres_wheels", "suspension", "infotainment", "safety_systems",
]

# form label -> checklist key; two keys are fed by two labels each
FORM_ITEMS = [
    ("Engine Bay", "engine_bay"),
    ("Battery & Wiring", "electrical"),
    ("Brake System", "brakes"),
    ("Tyre Condition", "tyres_wheels"),
    ("Exterior Paint", "paint_finish"),
    ("Windshield & Glass", "exterior_body"),
    ("Interior Trim", "exterior_body"),
    ("Infotainment System", "infotainment"),
    ("AC & Ventilation", "ac_system"),
    ("Seat Belt & Airbags", "safety_systems"),
    ("Steering & Suspension", "suspension"),
    ("Lights & Indicators", "electrical"),
]

# default action when a submission names none
SUBMIT_ACTIONS = {"QUICK_FIX": "Quick fix applied", "FAIL": "Failed — needs repair"}
# action stored for a form status
FORM_ACTIONS = {"FAIL": "Needs repair", "QUICK_FIX": "Quick fix applied on site"}

DEFAULT_DEALER = "DLR-000"
DEFAULT_SIGNATURE = "Signed via ePOD App"
FALLBACK_CLASSIFICATION = ("Unknown", "Unclassified", 0.0)
