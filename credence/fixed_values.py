"""Fixed values.

Everything in this module is a value that decides results (word lists, lookup tables, patterns,
thresholds, message texts).  They are stated plainly and in their natural order, because several
rules depend on "the first listed entry that matches".
"""

# --- Fixed values: reference year and thresholds --------------------------------------------

AS_OF_YEAR = 2026
DEFAULT_DETECT_CONFIDENCE = 25.0
DEFAULT_ACCEPT_CONFIDENCE = 60.0
VERIFIED_FROM = 75

# --- Fixed values: detector classes (class, type, description, minimum confidence) ------------

DOC_CLASSES = [
    ("MKU Degree", "degree", "Mount Kenya University Degree Certificate", 40.0),
    ("MKU Transcript", "transcript", "Mount Kenya University Academic Transcript", 40.0),
    ("NESA Certificate", "certificate", "National Examination and School Inspection Certificate", 40.0),
    ("RP Degree", "degree", "Rwanda Polytechnic Degree Certificate", 40.0),
    ("RP Transcript", "transcript", "Rwanda Polytechnic Academic Transcript", 40.0),
    ("Rwanda Driving License", "license", "Rwanda Driving License", 30.0),
    ("Rwanda National ID", "id", "Rwanda National Identification Card", 40.0),
    ("ULK Degree", "degree", "Universite Libre de Kigali Degree Certificate", 40.0),
    ("ULK Transcript", "transcript", "Universite Libre de Kigali Academic Transcript", 40.0),
    ("UR Degree", "degree", "University of Rwanda Degree Certificate", 40.0),
    ("UR Transcript", "transcript", "University of Rwanda Academic Transcript", 40.0),
    ("UTAB Degree", "degree", "University of Technology and Arts of Byumba Degree Certificate", 40.0),
    ("UTAB Transcript", "transcript", "University of Technology and Arts of Byumba Academic Transcript", 40.0),
]

# Classes whose printed name is compared with the candidate name.
NAME_CHECKED_CLASSES = ["UR Degree", "UR Transcript", "ULK Degree", "ULK Transcript"]

# Classes whose low-confidence hint names the class.
HINT_NAMED_CLASSES = ["Rwanda Driving License", "Rwanda National ID"]

# Selected document type -> detector types it accepts.
ACCEPTED_TYPES = {
    "national_id": ["id"],
    "driving_license": ["license"],
    "certificate": ["certificate", "degree"],
    "transcript": ["transcript"],
}

# --- Fixed values: link domains, in matching order --------------------------------------------

TRUSTED_DOMAINS = [
    "graduate.rp.ac.rw", "graduate.nesa.gov.rw", "rp.ac.rw", "ur.ac.rw",
    "ulk.ac.rw", "utab.ac.rw", "mku.ac.ke", "nesa.gov.rw", "nesa.rw",
    "nida.gov.rw", "rra.gov.rw", "rtda.gov.rw", "gov.rw",
]

INSTITUTION_BY_DOMAIN = [
    ("graduate.rp.ac.rw", "Rwanda Polytechnic"),
    ("graduate.nesa.gov.rw", "NESA (National Exam Board)"),
    ("rp.ac.rw", "Rwanda Polytechnic"),
    ("ur.ac.rw", "University of Rwanda"),
    ("ulk.ac.rw", "Universite Libre de Kigali"),
    ("utab.ac.rw", "University of Technology and Arts of Byumba"),
    ("mku.ac.ke", "Mount Kenya University"),
    ("nesa.gov.rw", "NESA (National Exam Board)"),
    ("nesa.rw", "NESA (National Exam Board)"),
    ("nida.gov.rw", "NIDA (National ID Agency)"),
    ("rtda.gov.rw", "RTDA (Driving License Authority)"),
    ("gov.rw", "Government of Rwanda"),
]

# --- Fixed values: institution words by category, in matching order ---------------------------

INSTITUTION_WORDS = {
    "universities": [
        "UNIVERSITY OF RWANDA", "UR-", "KIGALI INDEPENDENT UNIVERSITY", "ULK",
        "UNIVERSITE LIBRE DE KIGALI", "INES RUHENGERI", "INES",
        "INSTITUT D'ENSEIGNEMENT SUPERIEUR DE RUHENGERI",
        "ADVENTIST UNIVERSITY OF CENTRAL AFRICA", "AUCA",
        "HIGHER INSTITUTE OF AGRICULTURE", "ISAE", "KIGALI HEALTH INSTITUTE", "KHI",
        "SCHOOL OF FINANCE AND BANKING", "SFB", "UNIVERSITE CATHOLIQUE DE KABGAYI", "UCK",
        "UNIVERSITY OF TOURISM TECHNOLOGY", "UTB", "AFRICAN LEADERSHIP UNIVERSITY", "ALU",
        "CARNEGIE MELLON UNIVERSITY AFRICA", "CMU AFRICA", "MOUNT KENYA UNIVERSITY", "MKU",
        "UNIVERSITY OF TECHNOLOGY AND ARTS", "UTAB",
    ],
    "polytechnics": [
        "RWANDA POLYTECHNIC", "POLYTECHNIC", "INTEGRATED POLYTECHNIC REGIONAL COLLEGE", "IPRC",
        "IPRC KIGALI", "IPRC HUYE", "IPRC MUSANZE", "IPRC RUBAVU", "IPRC RWAMAGANA", "IPRC TUMBA",
        "VOCATIONAL TRAINING CENTER", "VTC", "WDA", "WORKFORCE DEVELOPMENT AUTHORITY", "POLYTEC",
    ],
    "secondary": [
        "ECOLE DES SCIENCES", "LYCEE", "COLLEGE SAINT ANDRE", "GROUPE SCOLAIRE", "GS OFFICIEL",
        "SECONDARY SCHOOL", "HIGH SCHOOL", "SENIOR SIX", "NESA", "NATIONAL EXAMINATION",
        "RWANDA EDUCATION BOARD", "REB",
    ],
    "government": [
        "REPUBLIC OF RWANDA", "REPUBULIKA Y'U RWANDA", "GOVERNMENT OF RWANDA", "MINEDUC",
        "HIGHER EDUCATION COUNCIL", "HEC", "NATIONAL IDENTIFICATION AGENCY", "NIDA",
        "RWANDA NATIONAL POLICE", "RNP",
    ],
}

# Short code -> category it implies when no category is known yet.
SHORT_CODES = [
    ("RP", "polytechnics"), ("UR", "universities"), ("ULK", "universities"), ("MKU", "universities"),
    ("UTAB", "universities"), ("AUCA", "universities"), ("INES", "universities"),
    ("IPRC", "polytechnics"), ("WDA", "polytechnics"), ("REB", "government"), ("HEC", "government"),
    ("NIDA", "government"), ("ALU", "universities"), ("ISAE", "universities"),
    ("VTC", "polytechnics"), ("SFB", None), ("UCK", None), ("UTB", None), ("KHI", None),
]

# Fragment used only when nothing else is found -> category it implies.
INSTITUTION_FRAGMENTS = [
    ("POLYTECHNIC", "polytechnics"), ("POLYTEC", "polytechnics"), ("RWANDA POLY", None),
    ("UNIV OF RWANDA", "universities"), ("KIGALI UNIV", "universities"), ("IPRC", "polytechnics"),
    ("ISAE", None), ("AUCA", "universities"), ("INES", "universities"), ("ULK", "universities"),
    ("ALU", "universities"), ("WDA", "polytechnics"), ("REB", "government"), ("NIDA", "government"),
    ("HEC", "government"), ("MKU", "universities"), ("UTAB", "universities"), ("RP.AC.RW", None),
    ("UR.AC.RW", None), ("MINEDUC", "government"), ("GRADUATE.RP", None),
]

INSTITUTION_PRIORITY = [
    "RWANDA POLYTECHNIC (via URL)", "RWANDA POLYTECHNIC",
    "UNIVERSITY OF RWANDA (via URL)", "UNIVERSITY OF RWANDA", "RP", "UR", "POLYTECHNIC",
]

# --- Fixed values: document content words -------------------------------------------------------

ID_WORDS = [
    "REPUBLIC OF RWANDA", "REPUBULIKA", "NATIONAL ID", "INDANGAMUNTU", "NID", "NIDA",
    "DATE OF BIRTH", "ITARIKI", "AMAZINA", "NATIONALITY", "UBWENEGIHUGU", "RWANDA", "VALID",
    "DISTRICT", "AKARERE", "SEX", "UBWOKO",
]
WEAK_ID_WORDS = ["RWANDA", "REPUBLIC OF RWANDA"]

CERTIFICATE_WORDS = [
    "CERTIFICATE", "DIPLOMA", "DEGREE", "BACHELOR", "MASTER", "ADVANCED DIPLOMA",
    "THIS IS TO CERTIFY", "VICE CHANCELLOR", "RECTOR", "REGISTRAR", "CONGREGATION", "UNIVERSITY",
    "INSTITUTE", "COLLEGE", "RWANDA", "AWARD", "CONFERRED", "ACADEMIC", "GRADUATION", "CERTIFY",
    "SATISFIED", "HIGHER DIPLOMA", "HONOURS", "DISTINCTION", "FACULTY",
]
CERTIFICATE_PHRASES = [
    "SATISFIED THE REQUIREMENTS", "REQUIREMENTS FOR THE AWARD", "ADVANCED DIPLOMA", "SECOND CLASS",
    "CONGREGATION", "TWO THOUSAND", "GRADUATE.RP", "RP.AC.RW", "RWANDA POLYTECHNIC",
]

TRANSCRIPT_WORDS = [
    "TRANSCRIPT", "ACADEMIC RECORD", "GRADE", "CREDIT", "SEMESTER", "GPA", "CGPA", "PASS",
    "DISTINCTION", "MODULE", "COURSE", "STUDENT", "MARKS", "SCORE",
]

AUTHORITY_ROLES = [
    "VICE CHANCELLOR", "DEPUTY VICE CHANCELLOR", "PRO-VICE CHANCELLOR", "RECTOR", "REGISTRAR",
    "PRINCIPAL", "DIRECTOR", "PROVOST", "CHARGE OF ACADEMICS", "CHARGE OF ACADEMIC",
    "INSTITUTIONAL ADVANCEMENT", "ACADEMICS RESEARCH",
    # tried only after all of the above
    "CHANCELLOR", "RECTOR", "REGISTRAR", "CHARGE OF ACAD",
]

YEAR_WORDS = ["TWO THOUSAND", "NINETEEN", "TWENTY"]
OFFICIAL_HOSTS = ["RP.AC.RW", "UR.AC.RW", "GRADUATE.RP"]

# Words counted as a model feature, and the roles of the authority feature.
FEATURE_WORDS = [
    "REPUBLIC OF RWANDA", "RWANDA POLYTECHNIC", "UNIVERSITY OF RWANDA", "INDANGAMUNTU", "NIDA",
    "NATIONAL ID", "CERTIFICATE", "DIPLOMA", "DEGREE", "TRANSCRIPT", "IPRC", "RP", "UR", "WDA",
    "REB", "KIGALI", "RWANDA", "VICE CHANCELLOR", "RECTOR", "REGISTRAR", "THIS IS TO CERTIFY",
    "ADVANCED DIPLOMA", "CONGREGATION", "POLYTECHNIC", "POLYTEC",
]
FEATURE_ROLES = [
    "VICE CHANCELLOR", "RECTOR", "REGISTRAR", "PRINCIPAL", "DIRECTOR", "CHANCELLOR",
    "CHARGE OF ACADEMICS", "INSTITUTIONAL ADVANCEMENT",
]
FEATURE_NAMES = [
    "resolution", "sharpness", "edge_density", "white_ratio", "saturation", "texture", "noise",
    "clone_score", "word_count", "rwanda_keywords", "authority_found", "date_found",
    "id_number_found", "face_found", "qr_found",
]

# --- Fixed values: words that are not part of a person's name ------------------------------------

NAME_STOP_WORDS = [
    "REPUBLIC", "RWANDA", "OF", "THE", "NATIONAL", "ID", "DIPLOMA", "CERTIFICATE", "TRANSCRIPT",
    "DATE", "BIRTH", "NAME", "AMAZINA", "NOM", "PRENOM", "GRADE", "UNIVERSITY", "INSTITUTE",
    "COLLEGE", "POLYTECHNIC", "SCHOOL", "DEGREE", "AWARDED", "REGISTRAR", "RECTOR", "VICE",
    "CHANCELLOR", "DIRECTOR", "YEAR", "STUDENT", "MARKS", "CGPA", "GPA", "COURSE", "CANDIDATE",
    "NUMBER", "NIDA", "GOVERNMENT", "MINISTRY", "MINEDUC",
]
FIELD_OF_STUDY_WORDS = [
    "BUSINESS", "TECHNOLOGY", "SCIENCE", "HONOURS", "BACHELOR", "MASTER", "DIVISION", "ECONOMICS",
    "COLLEGE", "INFORMATION", "CONGREGATION",
]
# A person name read from a link or page ends before one of these words ...
PERSON_NAME_END = (
    r"\b(?:BACHELOR|MASTER|DOCTOR|DIPLOMA|CERTIFICATE|DEGREE|FACULTY|SCHOOL|PROGRAM|PROGRAMME"
    r"|REGISTRATION|REG\s*NO|DEPARTMENT|COLLEGE|OPTION|GRADE|DIVISION|UPPER|LOWER|CAMPUS|INSTITUTE)\b"
)
# ... and must not contain one of these.
PERSON_NAME_BLOCKED = [
    "CERTIFICATE", "VERIFY", "VERIFIED", "VALID", "ONLINE", "DOCUMENT", "UNIVERSITY", "TECHNOLOGY",
    "ARTS", "BYUMBA", "UTAB", "RWANDA", "INFORMATION", "CONTACT", "PLEASE", "EMAIL", "CALL",
    "OFFICER", "COMMUNICATION", "DEPARTMENT", "COLLEGE", "OPTION", "GRADE", "DIVISION", "INSTITUTE",
    "CAMPUS", "POLYTECHNIC",
]

# Phrases around a holder name, tried in this order; (needed literals, pattern).
HOLDER_ANCHORS = [
    (["CONFERS"], r"CONFERS\s+UPON\s+YOU[\s\n]+([A-Z][A-Z\s\']{4,40}?)[\s\n]+(?:THE\s+DEGREE|IS\s+AWARDED)"),
    (["COLLEGE", "AWARDED"], r"(?:COLLEGE\s+OF\s+[\w\s]+?)[\s\n]+([A-Z][A-Z\s\']{4,40}?)[\s\n]+IS\s+AWARDED"),
    (["AWARDED", "BACHELOR"], r"IS\s+AWARDED\s+THE\s+DEGREE\s+OF[\s\n]+([A-Z][A-Z\s\']{4,40}?)[\s\n]+BACHELOR"),
    (["CERTIF"], r"(?:CERTIFY\s+THAT|CERTIFIES\s+THAT)[\s\n]+([A-Z][A-Z\s\']{4,40}?)[\s\n]+(?:HAVING|HAS)"),
    (["AWARDED"], r"([A-Z][A-Z\s\']{4,40}?)[\s\n]+IS\s+AWARDED\s+THE\s+DEGREE"),
]
HOLDER_LABELS = [
    r"(?:AMAZINA|NAME|FULL NAME|GIVEN NAME|NOM(?:\s+COMPLET)?|PRENOM|IZINA)\s*[:\-]?\s*([A-Z][A-Z\s']{3,})",
    r"(?:NAME OF HOLDER|HOLDER NAME|PERSON NAME)\s*[:\-]?\s*([A-Z][A-Z\s']{3,})",
]

# --- Fixed values: reference number patterns ------------------------------------------------------

NATIONAL_ID_NUMBER = r"\b([12]\d{15})\b"
ANY_16_DIGITS = r"\b(\d{16})\b"
EXAM_NUMBER_PATTERNS = [
    r"\b(?:NESA|REB)[/\-_]?(20\d{2})[/\-_]?(\d{4,8})\b",
    r"\bS6[/\-_]?(20\d{2})[/\-_]?(\d{4,6})\b",
]
EXAM_NUMBER_PLAIN = r"\b(\d{8,12})\b"

# University code -> (pattern, index of its year group or 0) in matching order.
UNIVERSITY_NUMBER_PATTERNS = {
    "UR": [
        (r"\bUR[/\-_]?(20\d{2})[/\-_]?[A-Z]{0,6}[/\-_]?(\d{3,8})\b", 1),
        (r"\bURN?\d{5,10}\b", 0),
    ],
    "ULK": [
        (r"\bULK[/\-_]?(20\d{2})[/\-_]?(\d{4,8})\b", 1),
        (r"\bULK\d{4,10}\b", 0),
        (r"\b[A-Z]{1,2}\d{1,2}[/\-_](20\d{2})[/\-_](\d{3,6})\b", 1),
        (r"\b[A-Z]{1,2}\d{1}[\-](20\d{2})[\-]\d{3,6}\b", 1),
    ],
    "MKU": [
        (r"\bMKU[/\-_]?(20\d{2})?[/\-_]?(\d{4,8})\b", 1),
        (r"\bMKU[\-]?\d{4,10}\b", 0),
    ],
    "UTAB": [
        (r"\bUTAB[/\-_]?(20\d{2})?[/\-_]?(\d{4,8})\b", 1),
        (r"\bUTAB[\-]?\d{4,10}\b", 0),
    ],
}
LABELLED_NUMBER = (
    r"\b(?:CERT(?:IFICATE)?|DEGREE|DIPLOMA|REG(?:ISTRATION)?|REF(?:ERENCE)?|NO|NUMBER|#)"
    r"[:\s#\.]*([A-Z0-9]{5,14})\b"
)
PLAIN_NUMBER = r"\b(\d{6,12})\b"

# Word in the text -> university code, first listed wins.
UNIVERSITY_CODE_WORDS = [
    ("UNIVERSITY OF RWANDA", "UR"), ("UR-", "UR"), ("KIGALI INDEPENDENT UNIVERSITY", "ULK"),
    ("UNIVERSITE LIBRE DE KIGALI", "ULK"), ("ULK", "ULK"), ("MOUNT KENYA UNIVERSITY", "MKU"),
    ("MKU", "MKU"), ("UNIVERSITY OF TECHNOLOGY AND ARTS", "UTAB"), ("UTAB", "UTAB"),
]

# Words that route a text to a number check.
ROUTE_ID_WORDS = [
    "INDANGAMUNTU", "NATIONAL ID", "NID", "NIDA", "DATE OF BIRTH", "ITARIKI", "UBWENEGIHUGU",
    "NATIONAL IDENTIFICATION",
]
ROUTE_EXAM_WORDS = [
    "NESA", "NATIONAL EXAMINATION", "RWANDA EDUCATION BOARD", "REB", "SENIOR SIX", "S6",
    "SECONDARY", "UACE", "UCE", "ADVANCED LEVEL", "ORDINARY LEVEL",
]
ROUTE_UNIVERSITY_WORDS = [
    "UNIVERSITY OF RWANDA", "KIGALI INDEPENDENT UNIVERSITY", "UNIVERSITE LIBRE DE KIGALI",
    "MOUNT KENYA UNIVERSITY", "UNIVERSITY OF TECHNOLOGY AND ARTS", "ULK", "MKU", "UTAB",
]

# Digits misread as letters in exam serials: letter -> digit.
SERIAL_LETTERS = "OQILNZSBE"
SERIAL_DIGITS = "001127588"

# --- Fixed values: embedded-data links ---------------------------------------------------------------

EMBEDDED_CERT_PATTERNS = [
    r"\b([A-Z]{2,6})/(\d{4})/(\d{4,8})\b",
    r"\b([A-Z]{2,6}T)/(\d{4})/(\d{3,8})\b",
]
EMBEDDED_CERT_WORDS = [
    "MOUNT KENYA", "MKU", "BACHELOR", "MASTER", "DOCTOR", "HONOURS", "DIVISION", "CONGREGATION",
    "UNIVERSITY COUNCIL", "SENATE", "REGISTRAR", "CHANCELLOR",
]
EMBEDDED_NAME = r"^([A-Z][A-Z\s]{3,40}?)(?:\s+(?:BACHELOR|MASTER|DOCTOR|SECOND|FIRST|THIRD|PASS))"

# --- Fixed values: link query keys ----------------------------------------------------------------------

SERIAL_KEYS = ["serial", "certificate", "cert", "number", "id", "ref"]
NAME_KEYS = [
    "name", "names", "full_name", "fullname", "student", "student_name", "student_names",
    "studentnames", "student_full_name", "studentfullname", "holder", "holder_name", "candidate",
    "candidate_name", "graduate", "graduate_name", "beneficiary", "owner", "owner_name", "degree_owner",
]

# --- Fixed values: words on verification pages -----------------------------------------------------------

PAGE_WORDS = ["CERTIFICATE", "DIPLOMA", "DEGREE", "VERIFIED", "GRADUATE", "VALID"]
PAGE_ERRORS = ["NOT FOUND", "INVALID", "ERROR", "NO RECORD", "404"]
POLYTECHNIC_PAGE_WORDS = [
    "CERTIFICATE VERIFIED", "VALID CERTIFICATE", "VALID", "STUDENT NAME", "STUDENT NAMES", "NAMES",
    "GRADUATE", "CERTIFICATE NO", "CERTIFICATE NUMBER", "RWANDA POLYTECHNIC", "NAME:", "CODE:",
    "REGISTRATION NUMBER:",
]
POLYTECHNIC_PAGE_ERRORS = ["NOT FOUND", "INVALID", "NO RECORD", "DOES NOT EXIST", "CERTIFICATE NOT FOUND"]
EXAM_PAGE_ERRORS = ["INVALID", "NOT FOUND", "NO RECORD"]

PAGE_NAME_LABELS = [
    "NAME", "NAMES", "FULL NAME", "STUDENT NAME", "STUDENT NAMES", "HOLDER NAME", "CANDIDATE NAME",
    "GRADUATE NAME", "GRADUATE",
]
PAGE_NAME_STOP = (
    r"(?:PROGRAM(?:ME)?|FACULTY|SCHOOL|CLASS|DIVISION|YEAR|STATUS|VALID|CERTIFICATE|BACHELOR|MASTER"
    r"|DOCTOR|DIPLOMA|REGISTRATION|REG\s*NO|AWARD|GRADUATION|DEPARTMENT|MAJOR|GPA|CGPA|GRADE|INDEX"
    r"|EXAMINATION|AGGREGATE|MENTION|CONGREGATION|COLLEGE|INSTITUTE|CAMPUS|STUDY|COURSE"
    r"|QUALIFICATION|LEVEL|HONOURS|DISTINCTION)"
)
PAGE_NAME_LABEL = (
    r"(?:STUDENT\s+NAMES?|STUDENT\s+NAME|GRADUATE\s+NAME|FULL\s+NAME|HOLDER\s+NAME"
    r"|CANDIDATE\s+NAME|NAMES?)"
)
PAGE_NAME_END = r"(?:\s+" + PAGE_NAME_STOP + r"|\s*$|\n|<)"
# (one of these literals is needed, pattern), tried in this order
PAGE_NAME_PATTERNS = [
    (["REGISTRATION"], r"([A-Z][A-Z\s']{3,60}?)\s+REGISTRATION\s+NUMBER"),
    (["REG"], r"([A-Z][A-Z\s']{3,60}?)\s+REG\s*NO"),
    (["NAME"], PAGE_NAME_LABEL + r"\s*[:\-]?\s*([A-Z][A-Z\s']{2,60}?)" + PAGE_NAME_END),
    (["STUDENT", "HOLDER", "CANDIDATE", "GRADUATE"],
     r"(?:STUDENT|HOLDER|CANDIDATE|GRADUATE)\s*:\s*([A-Z][A-Z\s']{2,60}?)" + PAGE_NAME_END),
    (["AWARDED", "CONFERRED", "ISSUED", "CERTIFY"],
     r"(?:AWARDED\s+TO|CONFERRED\s+ON|ISSUED\s+TO|CERTIFY\s+THAT)\s*[:\-]?\s*([A-Z][A-Z\s']{2,60}?)" + PAGE_NAME_END),
]
REGISTRATION_LINE = r"\b(?:REGISTRATION\s+NUMBER|REG\s*NO|REGISTRATION\s+NO)\b"
EXAM_PAGE_NAME = (
    r"GRADUATE\s+NAME\s*[:\s]+([A-Z][A-Z\s'\-]{3,80}?)"
    r"(?:\s+(?:INDEX\s+NUMBER|EXAMINATION\s+AUTHORITY|SCHOOL|EXAM\s+YEAR|MENTION|AGGREGATE)|$)"
)

# --- Fixed values: capture software, in matching order -------------------------------------------------------

EDITING_SOFTWARE = [
    "adobe photoshop", "photoshop", "gimp", "paint.net", "inkscape", "canva", "pixlr", "fotor",
    "befunky", "picsart", "snapseed", "lightroom", "affinity photo", "corel", "paintshop",
    "microsoft paint", "ms paint", "paint 3d", "online image editor", "iloveimg", "remove.bg",
    "img2go", "lunapic", "picmonkey", "fotojet",
]
LEGITIMATE_SOFTWARE = [
    "scanner", "scan", "epson", "canon", "hp", "fujitsu", "brother", "nikon", "samsung", "xerox",
    "ricoh", "konica", "sharp", "iphone", "android", "samsung camera", "pixel", "adobe acrobat",
    "acrobat", "pdf", "microsoft office", "word", "windows camera", "camera", "camscanner",
    "adobe scan", "microsoft lens", "genius scan", "turboscan", "scanbot", "tiny scanner",
]
SCANNER_SOFTWARE = [
    "scanner", "scan", "epson", "canon", "hp", "fujitsu", "brother", "xerox", "ricoh",
]
SOFTWARE_TAGS = ["Software", "ProcessingSoftware", "HostComputer"]
KEY_EXIF_TAGS = [
    "Software", "Make", "Model", "DateTimeOriginal", "DateTimeDigitized", "DateTime", "ProcessingSoftware",
]
EXIF_EXTENSIONS = ["jpg", "jpeg", "png", "tiff", "tif", "webp"]

# --- Fixed values: uploads ------------------------------------------------------------------------------------

UPLOAD_EXTENSIONS = ["jpg", "jpeg", "png", "pdf"]
UPLOAD_MAX_BYTES = 5 * 1024 * 1024
IMAGE_MIME_TYPES = ["image/jpeg", "image/png", "image/jpg"]
IMAGE_MAX_BYTES = 10 * 1024 * 1024

# --- Fixed values: date shapes ------------------------------------------------------------------------------------

DATE_SHAPES = [r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}", r"\d{4}-\d{2}-\d{2}", r"\d{2}\.\d{2}\.\d{4}"]
ANY_DATE = r"\d{2}[./\-]\d{2}[./\-]\d{4}|\d{4}[./\-]\d{2}[./\-]\d{2}"
GRADE_VALUE = r"\b\d{1,3}\.\d{1,2}\b|\b\d{1,3}%"
ISSUE_YEAR = r"\b(19|20)\d{2}\b"

# --- Fixed values: training-set augmentation -------------------------------------------------------------------------

TAMPER_METHODS = ["text_edit", "clone", "blur", "noise", "resize_quality", "color_shift", "whiteout"]

# --- Fixed values: error-level thresholds -----------------------------------------------------------------------------

HIGH_ERROR_RATIO = 0.15
HIGH_ERROR_MEAN = 12.0
HIGH_ERROR_STD = 18.0

# --- Fixed values: overall recommendation by worst status ---------------------------------------------------------------

RECOMMENDATIONS = {
    "Verified": (
        "All documents have passed verification. This candidate's credentials appear authentic. "
        "You may proceed with the recruitment process."
    ),
    "Suspicious": (
        "Some documents raised concerns. It is recommended to request original documents "
        "and conduct a manual review before making a hiring decision."
    ),
    "Fake": (
        "One or more documents show strong signs of forgery or tampering. "
        "This application should be rejected and the case may be escalated for further investigation."
    ),
}
