"""Fixed values of the form: fields, slots, sections, printed-label patterns, limits and codes.

Everything here has a fixed, small size (tens of rows), so the tables made from it are safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- Fixed values: versions, statuses, thresholds
SCHEMA_VERSION = "1.0"
LAYOUT_ID = "ma-fiche-surveillance-grossesse-v1"
EXTENDED_VERSION = "excel-ext-1"
KNOWN_CONFIDENCE = 0.75
READING_CONFIDENCE = 0.85
GA_GAP_DAYS = 14
GA_LIMIT_DAYS = 315
FIELD_STATUSES = ["KNOWN", "NEEDS_REVIEW", "ILLEGIBLE", "NOT_PROVIDED", "UNKNOWN", "NOT_APPLICABLE"]
MISSING_STATUSES = ["ILLEGIBLE", "NOT_PROVIDED", "UNKNOWN", "NOT_APPLICABLE"]
VERIFICATION_STATES = ["UNVERIFIED", "CONFIRMED", "CORRECTED"]
PII_ACTIONS = ["NOT_EXTRACTED", "REDACTED"]
ENCOUNTER_TYPES = ["ANTENATAL"]
REVIEWABLE = ["AI_PROCESSED", "NEEDS_REVIEW", "VALIDATED", "DUPLICATE_SUSPECTED", "PATIENT_MATCHED"]
REGISTERED = ["REGISTERED", "SYNCED"]
KEY_FIELDS = ["registry_file_number", "midwife_patient_code"]
CHANNELS = ["SIMULATOR", "WHATSAPP"]

# ---- Fixed values: visit columns in printed order
SLOTS = [
    ("T1_V1", "1er trimestre – visite 1"), ("T1_V2", "1er trimestre – visite 2"), ("T1_V3", "1er trimestre – visite 3"),
    ("T2_V1", "2e trimestre – visite 1"), ("T2_V2", "2e trimestre – visite 2"), ("T2_V3", "2e trimestre – visite 3"),
    ("M7", "7e mois"), ("M8", "8e mois"), ("M9", "9e mois"), ("MANUAL", "Saisie manuelle"),
]
GRID_SLOTS = [s for s, _ in SLOTS if s != "MANUAL"]

# ---- Fixed values: page sections
PAGE_SECTIONS = [
    ("cover", "Couverture (n° de fiche, établissement)"), ("identification", "Identification et antécédents"),
    ("current_pregnancy", "Grossesse actuelle (tableau des visites)"), ("delivery", "Accouchement"),
    ("postpartum", "Post-partum"), ("newborn", "Nouveau-né"),
]

# ---- Fixed values: choices with their accepted spellings
MARK = [("MARKED", ["case cochée", "cochée", "x"]), ("UNMARKED", ["case vide", "vide", "non cochée"])]
DELIVERY_MODE = [
    ("VAGINAL_NON_INSTRUMENTAL", ["voie basse non instrumentale"]), ("VAGINAL_INSTRUMENTAL", ["voie basse instrumentale"]),
    ("CESAREAN_PLANNED", ["césarienne programmée"]), ("CESAREAN_EMERGENCY", ["césarienne en urgence", "urgence"]),
]
NEWBORN_SEX = [("FEMALE", ["F", "féminin", "fille"]), ("MALE", ["M", "masculin", "garçon"])]
FEEDING = [("EXCLUSIVE_BREASTFEEDING", ["exclusivement au sein", "sein"]), ("ARTIFICIAL", ["artificiel"]), ("MIXED", ["mixte"])]
ENUM_SPELLINGS = {"NEGATIVE": ["negative", "negatif", "négatif", "neg", "nég", "-"],
                  "POSITIVE": ["positive", "positif", "pos", "+"]}

# ---- Fixed values: sections of the extended part: name, scope, item key, item values
EXTENDED_SECTIONS = [
    ("patient", "patient", None, []), ("pregnancy", "pregnancy", None, []),
    ("previous_deliveries", "previous_delivery", "column", ["1", "2", "3", "4", "5"]),
    ("visit_labs", "visit", "slot", GRID_SLOTS), ("delivery", "delivery", None, []),
    ("newborns", "newborn", "index", ["1", "2", "3", "4", "5", "6", "7", "8", "9"]),
    ("newborn_consultations", "newborn_consultation", "period", ["EARLY", "LATE"]),
]

# ---- Fixed values: fields as (name, section, kind, label, unit, min, max, required, choices, decimals, page)
# section "document" and "encounter" are the base part.
_FIELDS = [
    ("registry_file_number", "document", "digits", "N° de la fiche", None, None, None, False, [], 1, "cover"),
    ("midwife_patient_code", "document", "code", "Code patiente (sage-femme)", None, None, None, False, [], 1, "cover"),
    ("facility_name", "document", "text", "Établissement", None, None, None, False, [], 1, "cover"),
    ("last_menstrual_period", "document", "date", "DDR (dernières règles)", None, None, None, False, [], 1, "current_pregnancy"),
    ("visit_date", "encounter", "date", "Date de visite", None, None, None, True, [], 1, "current_pregnancy"),
    ("gestational_age_days", "encounter", "gestational_age", "Âge gestationnel", "days", 0, 315, False, [], 1, "current_pregnancy"),
    ("weight_kg", "encounter", "decimal", "Poids", "kg", 30, 200, False, [], 1, "current_pregnancy"),
    ("systolic_bp_mmhg", "encounter", "bp", "TA systolique", "mmHg", 60, 250, False, [], 1, "current_pregnancy"),
    ("diastolic_bp_mmhg", "encounter", "bp", "TA diastolique", "mmHg", 30, 150, False, [], 1, "current_pregnancy"),
    ("fundal_height_cm", "encounter", "int", "Hauteur utérine", "cm", 5, 50, False, [], 1, "current_pregnancy"),
    ("syphilis_test", "encounter", "enum", "Syphilis (TPHA/VDRL)", None, None, None, False, [], 1, "current_pregnancy"),
    ("hiv_test", "encounter", "enum", "Sérologie VIH", None, None, None, False, [], 1, "current_pregnancy"),
    ("education_level_text", "patient", "text", "Niveau d'instruction", None, None, None, False, [], 1, "identification"),
    ("maternal_age_years", "pregnancy", "int", "Âge de la femme", "years", 10, 60, False, [], 1, "identification"),
    ("gravidity", "pregnancy", "int", "Gestation", None, 0, 20, False, [], 1, "identification"),
    ("parity", "pregnancy", "int", "Parité", None, 0, 20, False, [], 1, "identification"),
    ("living_children_count", "pregnancy", "int", "Nombre d'enfants vivants", None, 0, 20, False, [], 1, "identification"),
    ("abortions_count", "pregnancy", "int", "Avortements (nombre)", None, 0, 20, False, [], 1, "identification"),
    ("consanguinity_mark", "pregnancy", "choice", "Case « Consanguinité »", None, None, None, False, MARK, 1, "identification"),
    ("pregnancy_desired_mark", "pregnancy", "choice", "Case « Grossesse désirée »", None, None, None, False, MARK, 1, "identification"),
    ("height_cm", "pregnancy", "int", "Taille de la femme", "cm", 120, 200, False, [], 1, "current_pregnancy"),
    ("previous_delivery_date", "previous_deliveries", "date", "Date de l'accouchement antérieur", None, None, None, False, [], 1, "identification"),
    ("previous_delivery_mode_text", "previous_deliveries", "text", "Modalité d'extraction", None, None, None, False, [], 1, "identification"),
    ("hemoglobin_g_dl", "visit_labs", "decimal", "Hémoglobine", "g/dL", 3, 25, False, [], 1, "current_pregnancy"),
    ("blood_glucose_g_l", "visit_labs", "decimal", "Bilan glycémique", "g/L", 0.2, 6, False, [], 2, "current_pregnancy"),
    ("albuminuria", "visit_labs", "enum", "Albuminurie", None, None, None, False, [], 1, "current_pregnancy"),
    ("delivery_date", "delivery", "date", "Date de l'accouchement", None, None, None, False, [], 1, "delivery"),
    ("delivery_gestational_age_days", "delivery", "gestational_age", "Âge gestationnel à la naissance", "days", 140, 315, False, [], 1, "delivery"),
    ("delivery_mode", "delivery", "choice", "Mode de l'accouchement", None, None, None, False, DELIVERY_MODE, 1, "delivery"),
    ("newborn_sex", "newborns", "choice", "Sexe du nouveau-né", None, None, None, False, NEWBORN_SEX, 1, "delivery"),
    ("birth_weight_g", "newborns", "int", "Poids à la naissance", "g", 300, 7000, False, [], 1, "delivery"),
    ("birth_head_circumference_cm", "newborns", "decimal", "Périmètre crânien à la naissance", "cm", 20, 50, False, [], 1, "delivery"),
    ("consultation_date", "newborn_consultations", "date", "Date de la consultation", None, None, None, False, [], 1, "newborn"),
    ("feeding_mode", "newborn_consultations", "choice", "Allaitement le jour de la consultation", None, None, None, False, FEEDING, 1, "newborn"),
]
UNIT_SPELLINGS = {"years": ["years", "ans", "an"], "g": ["gr", "g"]}
DOCUMENT_FIELDS = [f[0] for f in _FIELDS if f[1] == "document"]
ENCOUNTER_FIELDS = [f[0] for f in _FIELDS if f[1] == "encounter"]
EXTENDED_FIELDS = [f[0] for f in _FIELDS if f[1] not in ("document", "encounter")]

# ---- Fixed values: printed labels of each page type
SECTION_SIGNS = [
    ("cover", r"fiche de surveillance de la grossesse"), ("cover", r"type de l.?etablissement"),
    ("cover", r"grossesse classee a risque"), ("cover", r"n\s*[°o]?\s*de\s*la\s*fiche"),
    ("cover", r"nom\s*de\s*l.?\s*etablissement"),
    ("identification", r"identification et antecedents"), ("identification", r"antecedents de la femme"),
    ("identification", r"antecedents obstetricaux"), ("identification", r"accouchements anterieurs"),
    ("identification", r"antecedents hereditaires"),
    ("current_pregnancy", r"grossesse actuelle"), ("current_pregnancy", r"examen clinique"),
    ("current_pregnancy", r"examen biologique"), ("current_pregnancy", r"prestations\s*/\s*visites"),
    ("current_pregnancy", r"age probable"), ("current_pregnancy", r"syphilis"), ("current_pregnancy", r"serologie vih"),
    ("delivery", r"deroulement de l.?accouchement"), ("delivery", r"au moment de l.?accouchement"),
    ("delivery", r"voie basse instrumentale"), ("delivery", r"suites de couches"),
    ("postpartum", r"etat des lochies"), ("postpartum", r"etat du perinee"), ("postpartum", r"planification familiale"),
    ("postpartum", r"globe uterin"),
    ("newborn", r"etat vaccinal"), ("newborn", r"allaitement maternel"), ("newborn", r"affection grave"),
    ("newborn", r"luxation congenitale"),
]
PII_LABELS = [
    ("PATIENT_NAME", r"nom\s*/?\s*prenom|parturiente"), ("NATIONAL_ID", r"\bcin\b"), ("PHONE", r"telephone|\btel\b"),
    ("ADDRESS", r"adresse"), ("HUSBAND_NAME", r"\bmari\b"), ("STAFF_NAME", r"examen\s*fait\s*par"),
]
VISIT_HEADER = r"vi\S{2,4}\s+\S{1,2}|vi\S{2,4}\d"
MONTH_HEADER = r"\S{1,3}\s*\S{0,4}\s*mois"
# One of these is in every text that one of the two patterns matches.
HEADER_PIECES = ["vi", "mois"]
# row key, pattern of its printed label, printed label, is a laboratory row
GRID_ROWS = [
    ("visit_date", r"venue\s*le\b", "Venue le", False), ("gestational_age_days", r"age\s*probable", "Age probable", False),
    ("weight_kg", r"poids\b", "Poids (kg)", False), ("bp", r"t\.?\s*a\.?", "TA", False),
    ("fundal_height_cm", r"h\.?\s*u\b(?!\w)", "HU (cm)", False),
    ("syphilis_test", r"syph\w*\s*\(?(?:tpha|vdrl).*|syph\w*", "Syphilis (TPHA/VDRL)", False),
    ("hiv_test", r"serologie\s*vih|vih", "Sérologie VIH", False),
    ("hemoglobin_g_dl", r"hemoglobine", "Hémoglobine", True), ("blood_glucose_g_l", r"bilan\s*glyc\w*", "Bilan glycémique", True),
    ("albuminuria", r"albuminurie", "Albuminurie", True),
]
# section, field, pattern of the printed label, printed label
LABELLED = [
    ("cover", "registry_file_number", r"n\s*[°o]?\s*de\s*la\s*fiche", "N° de la fiche"),
    ("cover", "facility_name", r"nom\s*de\s*l.?\s*etablissement", "Nom de l'établissement sanitaire"),
    ("cover", "midwife_patient_code", r"^(?:code(?!\s*postal)(?:\s+\w+){0,2}|cm)\s*:", "Code"),
    ("current_pregnancy", "last_menstrual_period", r"^ddr\b", "DDR"),
    ("identification", "maternal_age_years", r"^age\s*:", "Age"),
    ("identification", "education_level_text", r"^niveau\s*d.?\s*instruction", "Niveau d'instruction"),
    ("identification", "gravidity", r"^gestation\b", "Gestation"), ("identification", "parity", r"^parite\b", "Parité"),
    ("identification", "living_children_count", r"enfants\s*vivants", "Nombre d'enfants vivants"),
    ("current_pregnancy", "height_cm", r"^taille\b", "Taille"),
    ("delivery", "delivery_date", r"date\s*de\s*l.?\s*accouchement", "Date de l'accouchement"),
    ("delivery", "delivery_gestational_age_days", r"^age\s*gestationnel", "Âge gestationnel"),
    ("delivery", "newborn_sex", r"^sexe\b", "Sexe"),
    ("delivery", "birth_weight_g", r"poids\s*a\s*la\s*naissance", "Poids à la naissance"),
    ("delivery", "birth_head_circumference_cm", r"perimetre\s*cranien\s*a\s*la\s*naissance", "Périmètre crânien à la naissance"),
    ("newborn", "consultation_date", r"date\s*de\s*la\s*consultation", "Date de la consultation"),
]
# field, pattern of the label beside its single box, printed label
SINGLE_BOXES = [
    ("consanguinity_mark", r"consanguinite", "Consanguinité"),
    ("pregnancy_desired_mark", r"grossesse\s*desiree", "Grossesse désirée"),
]
# field, option, pattern of the label beside the option's box, printed label
CHOICE_BOXES = [
    ("delivery_mode", "VAGINAL_NON_INSTRUMENTAL", r"voie\s*basse\s*non\s*instrumentale", "Voie basse non instrumentale"),
    ("delivery_mode", "VAGINAL_INSTRUMENTAL", r"voie\s*basse\s*instrumentale", "Voie basse instrumentale"),
    ("delivery_mode", "CESAREAN_PLANNED", r"cesarienne", "Césarienne : Programmée"),
    ("delivery_mode", "CESAREAN_EMERGENCY", r"\burgence$", "Urgence"),
    ("feeding_mode", "EXCLUSIVE_BREASTFEEDING", r"exclusivement\s*au\s*sein", "exclusivement au sein"),
    ("feeding_mode", "ARTIFICIAL", r"\bartificiel$", "Artificiel"), ("feeding_mode", "MIXED", r"\bmixte$", "mixte"),
]
# Where a box is looked for, in heights of its label from the start of the label's words, and the sides it may have.
BOX_BEFORE, BOX_AFTER, BOX_UP_DOWN, BOX_SIDES = 2.6, 1.8, 1.0, (0.5, 1.3)
PERIOD_TITLES = [("EARLY", r"post.?partum\s*precoce"), ("LATE", r"post.?partum\s*tardif")]
PREVIOUS_DELIVERY_HEADER = r"accouch\.?\s*(\d)"
PREVIOUS_DELIVERY_ROWS = [
    ("previous_delivery_date", r"^date$"), ("previous_delivery_mode_text", r"modalite"),
    ("indication", r"cesarienne\s*:?\s*indication|^si\s*cesar"), ("complication", r"^complication"),
    ("weight", r"poids\s*nouveau"), ("newborn_complication", r"compl\.?\s*nouveau"),
]
# Number pattern and unit suffix of a field or kind, for text read from a cell.
NUMBER_PATTERNS = {
    "maternal_age_years": (r"\d{2}", r"(?:ans?)?"), "gravidity": (r"\d{1,2}", ""), "parity": (r"\d{1,2}", ""),
    "living_children_count": (r"\d{1,2}", ""), "abortions_count": (r"\d{1,2}", ""), "height_cm": (r"\d{3}", r"(?:cm)?"),
    "hemoglobin_g_dl": (r"\d{1,2}(?:\.\d{1,2})?", r"(?:g\s*/\s*dl)?"),
    "blood_glucose_g_l": (r"\d(?:\.\d{1,2})?", r"(?:g\s*/\s*l)?"), "birth_weight_g": (r"\d{3,4}", r"(?:gr?)?"),
    "birth_head_circumference_cm": (r"\d{2}(?:\.\d)?", r"(?:cm)?"),
}
DATE_TEXT = r"\d{1,2}\s*[/.\-]\s*\d{1,2}\s*[/.\-]\s*\d{2,4}"
GESTATIONAL_AGE = (r"(\d{1,2})\s*(s\.?\s*a\.?|sem(?:aines?)?|s)?\s*(?:(\+|et\b)?\s*(\d{1,2})\s*(j(?:ours?)?\.?)?)?")
KIND_PATTERNS = {"date": (DATE_TEXT, ""), "gestational_age": (GESTATIONAL_AGE, ""),
                 "decimal": (r"\d{2,3}(?:\.\d)?", r"(?:kg)?"), "int": (r"\d{1,2}", r"(?:cm)?")}
BP_TEXT = r"(\d{2,3}(?:\.\d)?)/(\d{1,3}(?:\.\d)?)"
DASHES = ["-", "–", "—", "_", "--", "−"]
CONFIRM_REQUIRED = ["education_level_text", "previous_delivery_mode_text", "gravidity", "parity", "living_children_count",
                    "abortions_count"]
OCR_SWAPS = ("OolIº°b", "0011006")

# ---- Fixed values: limits of layout reading, photos and ink
MAX_SKEW_RADIANS = 0.2
SPAN_SHARE = 0.25
MAX_BLANK_INK = 0.01
FRAME_TOLERANCE = 0.01
MIN_INK_DEPTH = 40
MARKED_INK, UNMARKED_INK = 0.18, 0.04
MIN_IMAGE_BYTES, MIN_IMAGE_SIDE = 15_000, 600
DARK_MEAN, BRIGHT_MEAN, MIN_CONTRAST, MIN_SHARPNESS, MIN_TEXT_LINES = 35, 245, 35, 20.0, 5
MAX_MEDIA_BYTES = 8 * 1024 * 1024
RETAKE_REASONS = ["IMAGE_UNREADABLE", "IMAGE_TOO_SMALL", "IMAGE_TOO_DARK", "IMAGE_OVEREXPOSED", "IMAGE_LOW_CONTRAST",
                  "IMAGE_BLURRY", "NO_TEXT_FOUND"]
FAILURE_CODES = ["ILLEGIBLE_IMAGE", "UNSUPPORTED_LAYOUT", "EXTRACTION_FAILED"]
CONFLICT_FLAGS = ["CONFLICT_ACROSS_PAGES"]
CONSISTENCY_FLAGS = ["DATE_ORDER", "DATE_INCONSISTENT_WITH_DDR", "GA_INCONSISTENT_WITH_DDR", "GA_INCONSISTENT_WITH_VISITS"]

# ---- Fixed values: message delivery
TRANSIENT_CODES = [0, 2, 4, 190, 80007, 130429, 131000, 131016, 131056, 131057, 133004, 2494100]
MAX_ATTEMPTS, RETRY_BASE_SECONDS, RETRY_CAP_SECONDS = 10, 30, 3600
GROUP_WINDOW_SECONDS = 8
ACK_STATUSES = ["ACKNOWLEDGED", "ACKNOWLEDGED_SIMULATED"]

# ---- Fixed values: the 31 export columns as (header, coverage, paper inputs)
_DONE, _UNVERIFIED = "implemented and evaluated", "implemented but unverified"
_AGGREGATE, _NONE = "requires aggregation", "unavailable or awaiting definition"
COVERAGE = [_DONE, _UNVERIFIED, _AGGREGATE, _NONE]
EXPORT_COLUMNS = [
    ("id", _NONE, []), ("age (years)", _DONE, ["maternal_age_years"]),
    ("education level (0=none/primary,1=secondary,2=higher)", _NONE, ["education_level_text"]),
    ("consanguinity", _DONE, ["consanguinity_mark"]), ("desired pregnancy", _DONE, ["pregnancy_desired_mark"]),
    ("hypertension history", _NONE, []), ("diabetes mellitus", _NONE, []), ("gravidity (number)", _DONE, ["gravidity"]),
    ("parity (number)", _DONE, ["parity"]), ("abortions (number)", _UNVERIFIED, ["abortions_count"]),
    ("living children (number)", _DONE, ["living_children_count"]),
    ("previous cesarean", _AGGREGATE, ["previous_delivery_mode_text"]), ("bmi pregestational (kg/m2)", _NONE, ["height_cm"]),
    ("mean systolic bp (mmhg)", _AGGREGATE, ["systolic_bp_mmhg"]), ("mean diastolic bp (mmhg)", _AGGREGATE, ["diastolic_bp_mmhg"]),
    ("hemoglobin (g/dl)", _AGGREGATE, ["hemoglobin_g_dl"]), ("first fasting glucose (mg/dl)", _NONE, ["blood_glucose_g_l"]),
    ("proteinuria", _NONE, ["albuminuria"]), ("hiv test result", _AGGREGATE, ["hiv_test"]),
    ("syphilis test result", _AGGREGATE, ["syphilis_test"]), ("hepatitis c test result", _NONE, []),
    ("gestational age at enrollment (weeks)", _AGGREGATE, ["gestational_age_days", "visit_date"]), ("gestational dm", _NONE, []),
    ("gestational age at birth (weeks)", _DONE, ["delivery_gestational_age_days"]),
    ("preterm birth", _NONE, ["delivery_gestational_age_days"]),
    ("type of delivery (0=vaginal,1=cesarean)", _DONE, ["delivery_mode"]),
    ("newborn sex (0=female,1=male)", _DONE, ["newborn_sex"]), ("child birth weight (g)", _DONE, ["birth_weight_g"]),
    ("head circumference (cm)", _DONE, ["birth_head_circumference_cm"]), ("breastfeeding initiated", _NONE, ["feeding_mode"]),
    ("referral to higher care", _NONE, []),
]
EXPORT_HEADERS = [h for h, _c, _i in EXPORT_COLUMNS]

# ---- Fixed values: scoring
LAYOUTS = [
    (1, "cover", "cover", True), (2, "identification", "identification", True),
    (3, "current_pregnancy", "current_pregnancy", True), (4, "delivery", "delivery", True),
    (5, "postpartum_mother_early", "postpartum", False), (6, "newborn_early", "newborn", True),
    (7, "postpartum_mother_late", "postpartum", False), (8, "newborn_late", "newborn", True),
]
WRITTEN_OUTCOMES = ["correct_known", "wrong_known", "review_right", "review_wrong", "review_empty", "marked_illegible",
                    "claimed_missing", "no_field"]
EMPTY_OUTCOMES = ["missing_ok", "absent_ok", "review_on_blank", "blank_marked_illegible", "wrong_known_blank"]


def literal(value) -> str:
    """A Python constant as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(literal(v) for v in value) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, columns: dict[str, str], rows: list[tuple]) -> DataFrame:
    """A constant table as a local relation: its size is known to the optimizer, so joins to it broadcast."""
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST(c{i} AS {t}) AS {n}" for i, (n, t) in enumerate(columns.items()))
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(f'c{i}' for i in range(len(columns)))})")


def field_catalog(spark: SparkSession) -> DataFrame:
    """One row per field, in catalog order."""
    scopes = {name: (scope, key) for name, scope, key, _items in EXTENDED_SECTIONS}
    rows = []
    for ord_, (name, section, kind, label, unit, low, high, required, choices, decimals, page) in enumerate(_FIELDS):
        scope, item_key = scopes.get(section, (section, None))
        units = UNIT_SPELLINGS.get(unit, [unit] if unit else [])
        pattern = r"\s*(?:" + "|".join(u.lower() for u in units) + r")\.?$" if units else None
        rows.append((name, scope, section, item_key, kind, label, unit, None if low is None else float(low),
                     None if high is None else float(high), required, decimals, page, ord_, pattern,
                     [c for c, _s in choices]))
    return literal_table(spark, {
        "field": "string", "scope": "string", "section": "string", "item_key": "string", "kind": "string",
        "label": "string", "unit": "string", "minimum": "double", "maximum": "double", "required": "boolean",
        "decimals": "int", "page": "string", "ord": "int", "unit_pattern": "string", "choices": "array<string>"}, rows)


def choice_spellings(spark: SparkSession) -> DataFrame:
    """Every accepted spelling of every choice field: field, code, spelling."""
    rows = [(f[0], code, s) for f in _FIELDS for code, spellings in f[8] for s in [code, *spellings]]
    return literal_table(spark, {"field": "string", "code": "string", "spelling": "string"}, rows)


def slots(spark: SparkSession) -> DataFrame:
    return literal_table(spark, {"slot": "string", "slot_label": "string", "slot_ord": "int"},
                         [(s, label, i) for i, (s, label) in enumerate(SLOTS)])


def sections(spark: SparkSession) -> DataFrame:
    return literal_table(spark, {"section": "string", "section_label": "string"}, PAGE_SECTIONS)


def extended_sections(spark: SparkSession) -> DataFrame:
    return literal_table(spark, {"section": "string", "scope": "string", "item_key": "string", "item_values": "array<string>"},
                         EXTENDED_SECTIONS)


def patterns(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(label, pattern) rows with a number per pattern."""
    return literal_table(spark, {"label": "string", "pattern": "string", "pattern_no": "int"},
                         [(a, b, i) for i, (a, b) in enumerate(rows)])


def export_columns(spark: SparkSession) -> DataFrame:
    return literal_table(spark, {"number": "int", "header": "string", "category": "string", "inputs": "array<string>"},
                         [(i + 1, h, c, inputs) for i, (h, c, inputs) in enumerate(EXPORT_COLUMNS)])


def layouts(spark: SparkSession) -> DataFrame:
    return literal_table(spark, {"position": "int", "layout": "string", "expected_section": "string", "supported": "boolean"},
                         LAYOUTS)
