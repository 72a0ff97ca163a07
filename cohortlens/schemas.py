"""Canonical table schemas, keys and fixed values.

Everything here is data, not logic. The reports and import steps read these
names so that a deployment can swap thresholds without touching code.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B, D, TS = (T.StringType(), T.IntegerType(), T.BooleanType(),
                  T.DateType(), T.TimestampNTZType())


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# ---------------------------------------------------------------------------
# Canonical relational schemas (strings keep their declared max length in
# VARCHAR_LIMITS, checked by the constraint operator).
# ---------------------------------------------------------------------------
CANDIDATE = _struct(
    ("regnumber", S, False), ("maritalstatus", S, True), ("is_blind", B, True),
    ("is_deaf", B, True), ("address", S, True), ("noofsittings", I, True),
    ("is_mock_candidate", B, True), ("email", S, True), ("gsmno", S, True),
    ("surname", S, True), ("firstname", S, True), ("middlename", S, True),
    ("gender", S, True), ("statecode", I, True), ("aggregate", I, True),
    ("app_course1", S, True), ("inid", S, True), ("lg_id", I, True),
    ("year", I, False), ("is_admitted", B, True), ("is_direct_entry", B, True),
    ("malpractice", S, True), ("date_of_birth", D, True), ("saved_at", TS, True),
    ("created_at", TS, True), ("updated_at", TS, True),
)


COURSE = _struct(
    ("course_code", S, False), ("instid", I, True), ("facid", I, True),
    ("group_id", I, True), ("course_name", S, True),
    ("course_abbreviation", S, True), ("duration", I, True), ("degree", S, True),
)



# Primary keys and foreign keys of the relational model (checked by D5).
PRIMARY_KEYS = {
    "candidate": ["regnumber"],
    "candidate_scores": ["cand_reg_number", "subject_id", "year"],
    "course": ["course_code"],
    "faculty": ["fac_id"],
    "institution": ["inid"],
    "institution_type": ["intyp_id"],
    "lga": ["lg_id"],
    "state": ["st_id"],
    "subject": ["su_id"],
    "candidate_disabilities": ["cand_reg_number"],
    "candidate_exam_info": ["cand_reg_number"],
    "institution_names": ["inid", "effective_from"],
    "subject_mapping_2023": ["csv_code"],
    "course_code_mappings": ["id"],
    "historical_course_codes": ["id"],
}

FOREIGN_KEYS = [
    # (table, column, parent table, parent column)
    ("candidate", "statecode", "state", "st_id"),
    ("candidate", "app_course1", "course", "course_code"),
    ("candidate", "inid", "institution", "inid"),
    ("candidate", "lg_id", "lga", "lg_id"),
    ("candidate_scores", "cand_reg_number", "candidate", "regnumber"),
    ("candidate_scores", "subject_id", "subject", "su_id"),
    ("course", "facid", "faculty", "fac_id"),
    ("institution", "intyp", "institution_type", "intyp_id"),
    ("institution", "inst_state_id", "state", "st_id"),
    ("lga", "lg_st_id", "state", "st_id"),
    ("institution", "affiliated_state_id", "state", "st_id"),
    ("candidate_disabilities", "cand_reg_number", "candidate", "regnumber"),
    ("candidate_exam_info", "cand_reg_number", "candidate", "regnumber"),
    ("candidate_exam_info", "mock_state_id", "state", "st_id"),
    ("institution_names", "inid", "institution", "inid"),
    ("subject_mapping_2023", "su_id", "subject", "su_id"),
]

# Primary keys are NOT NULL; these columns too.
NOT_NULL = {name: list(key) for name, key in PRIMARY_KEYS.items()}
NOT_NULL["candidate"].append("year")
NOT_NULL["institution_names"] += ["inabv", "inname"]

VARCHAR_LIMITS = {
    "candidate": {"regnumber": 20, "maritalstatus": 20, "email": 100,
                  "gsmno": 20, "surname": 100, "firstname": 100,
                  "middlename": 100, "gender": 10, "app_course1": 100,
                  "inid": 20},
    "course": {"course_code": 100, "course_name": 200, "course_abbreviation": 50, "degree": 50},
    "institution": {"inid": 20, "inabv": 50, "inname": 200},
    "state": {"st_name": 100},
    "faculty": {"fac_code": 10, "fac_name": 100, "fac_abv": 20},
    "lga": {"lg_name": 100, "lg_abreviation": 50},
    "subject": {"su_abrv": 10, "su_name": 100},
    "institution_type": {"intyp_desc": 100, "inst_cat": 20},
    "candidate_disabilities": {"cand_reg_number": 20, "other_challenges": 100},
    "candidate_exam_info": {"cand_reg_number": 20, "exam_town": 100, "mock_town": 100, "exam_centre": 200, "exam_number": 20},
    "institution_names": {"inid": 20, "inabv": 50, "inname": 200},
    "subject_mapping_2023": {"csv_code": 10},
    "course_code_mappings": {"old_course_code": 100, "new_course_code": 100, "course_name": 200},
    "historical_course_codes": {"old_course_code": 100},
}

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------

# Report thresholds and limits (reference defaults).
REPORT_DEFAULTS = {
    "search_limit": 10,
    "top_performers": 10,
    "failed_imports": 10,
    "state_distribution": 10,
    "top_subjects": 5,
    "course_analysis": 15,
    "institution_stats": 15,
    "geographic_min": 1000,
    "geographic_n": 15,
    "trends_quantile": 0.75,
    "trends_min": 100,
    "trends_n": 15,
    "ranking_min": 100,
    "ranking_n": 20,
    "correlation_anchor": "USE OF ENGLISH",
    "correlation_min": 1000,
    "competitiveness_min": 50,
    "competitiveness_n": 20,
}

# Aggregate score bands, highest first: (lower bound, label); below the last
# bound the label is "Below 150".
SCORE_BANDS = [(300, "300+"), (250, "250-299"), (200, "200-249"), (150, "150-199")]
SCORE_BAND_FLOOR_LABEL = "Below 150"

# Candidate CSV header -> table column (source order of the import mapping).
CANDIDATE_CSV_MAPPING = [
    ("REGNUMBER", "regnumber"), ("SURNAME", "surname"),
    ("FIRSTNAME", "firstname"), ("MIDDLENAME", "middlename"),
    ("GENDER", "gender"), ("EMAIL", "email"), ("GSMNO", "gsmno"),
    ("STATECODE", "statecode"), ("LG_ID", "lg_id"), ("INID", "inid"),
    ("AGGREGATE", "aggregate"), ("APP_COURSE1", "app_course1"),
    ("IS_ADMITTED", "is_admitted"), ("IS_DIRECT_ENTRY", "is_direct_entry"),
    ("IS_BLIND", "is_blind"), ("IS_DEAF", "is_deaf"),
    ("IS_MOCK_CANDIDATE", "is_mock_candidate"),
    ("MARITALSTATUS", "maritalstatus"), ("ADDRESS", "address"),
    ("NOOFSITTINGS", "noofsittings"), ("MALPRACTICE", "malpractice"),
]
FLAG_TRUE_VALUES = ["yes", "true", "1"]
GENDER_VALUES = {"M": "M", "MALE": "M", "F": "F", "FEMALE": "F"}

# Course CSV headers (upper-cased, trimmed).
COURSE_CSV_COLUMNS = ["CODE", "NAME", "DESCRIPTION", "FACULTY_ID"]

# Placeholder course names that a conditional upsert may replace.
COURSE_PLACEHOLDER_LIKE = "Course%"

# State-name aliases applied after upper(trim()) and before lookup.
STATE_ALIASES = {
    "FCT ABUJA": "FCT",
    "FEDERAL CAPITAL TERRITORY": "FCT",
    "ABUJA": "FCT",
    "AKWA-IBOM": "AKWA IBOM",
    "CROSS-RIVER": "CROSS RIVER",
    "NASARAWA": "NASSARAWA",
    "AFRICA": "FOREIGNER",
    "WEST AFRICA": "FOREIGNER",
    "REPUBLIC OF BENIN": "COTONOU",
    "COTE D'IVORIE": "COTE D VOIRE",
    "COTE D'IVOIRE": "COTE D VOIRE",
}
STATE_MAX_DISTANCE = 2

# Header matching thresholds.
HEADER_MIN_CONFIDENCE = 0.6
HEADER_AUTO_ACCEPT = 0.8

# Geopolitical regions -> states.
REGIONS = {
    "north_central": ["BENUE", "FCT", "KOGI", "KWARA", "NASARAWA", "NIGER", "PLATEAU"],
    "north_east": ["ADAMAWA", "BAUCHI", "BORNO", "GOMBE", "TARABA", "YOBE"],
    "north_west": ["KADUNA", "KANO", "KATSINA", "KEBBI", "SOKOTO", "ZAMFARA", "JIGAWA"],
    "south_east": ["ABIA", "ANAMBRA", "EBONYI", "ENUGU", "IMO"],
    "south_south": ["AKWA IBOM", "BAYELSA", "CROSS RIVER", "DELTA", "EDO", "RIVERS"],
    "south_west": ["EKITI", "LAGOS", "OGUN", "ONDO", "OSUN", "OYO"],
}

# Question intents: first rule (in this order) with a contained keyword wins.
INTENT_RULES = [
    ("highest_score", ["highest"]),
    ("admission_stats", ["admitted", "admission"]),
    ("registration_stats", ["registered", "registration"]),
    ("disability_stats", ["disability", "disabilities"]),
    ("subject_scores", ["score", "subject"]),
    ("lga_stats", ["local", "lga"]),
    ("faculty_stats", ["faculty", "department"]),
    ("institution_stats", ["institution", "university", "school"]),
]
INTENT_DEFAULT = "general_stats"

# Years recognised in questions, checked in this order; default last year.
QUESTION_YEARS = ["2020", "2021", "2022", "2023"]
QUESTION_YEAR_DEFAULT = "2023"

# Course categories and their keywords. Priority = this declaration order.
COURSE_CATEGORIES = [
    ("medicine", ["medicine", "medical", "surgery", "health", "pharm", "anatomy", "optometry", "biomedical", "orthopedic", "physiotherapy"]),
    ("engineering", ["engineering", "engineer", "technology", "mechanical", "electrical", "electronic", "civil", "aerospace", "automotive", "chemical", "petroleum"]),
    ("science", ["science", "sciences", "biology", "chemistry", "physics", "mathematics", "statistics", "biochemistry", "biotechnology", "microbiology", "geology", "environmental"]),
    ("arts", ["art", "arts", "creative", "theatre", "music", "cultural", "literature", "language", "linguistics"]),
    ("management", ["management", "business", "admin", "accounting", "finance", "economics", "banking", "entrepreneurship", "logistics", "commerce"]),
    ("education", ["education", "teaching", "pedagogy", "curriculum", "instruction"]),
    ("agriculture", ["agriculture", "agricultural", "farming", "agronomy", "agribusiness", "crop", "animal science", "fisheries", "forestry"]),
    ("communication", ["communication", "media", "journalism", "broadcasting", "public relations", "mass communication"]),
    ("computing", ["computer", "computing", "software", "information technology", "data", "cybersecurity", "artificial intelligence"]),
    ("social_sciences", ["sociology", "psychology", "anthropology", "political science", "international relations", "social work", "geography"]),
    ("languages", ["english", "french", "arabic", "hausa", "yoruba", "igbo", "linguistics", "literature"]),
    ("religious_studies", ["islamic studies", "religious studies", "theology", "divinity", "christian religious studies"]),
    ("architecture", ["architecture", "building", "construction", "estate management", "quantity surveying", "urban planning"]),
    ("law", ["law", "legal studies", "jurisprudence"]),
    ("environmental", ["environmental", "ecology", "conservation", "climate", "biodiversity"]),
    ("hospitality", ["hospitality", "tourism", "hotel management", "catering"]),
]
COURSE_WORD_MIN_BYTES = 3
COURSE_FALLBACK_WORDS = ["course", "program"]
COURSE_FALLBACK_PATTERN = "'%COURSE%'"

# Markers stripped from a model reply before the SQL is read.
REPLY_STRIP_MARKERS = ["```json", "```", "`"]
