"""Small dictionaries of the clinical domain.  All of them are fixed values that results depend on."""

# French month names and their abbreviations, without accents or dots.
FRENCH_MONTHS = {
    "janv": 1, "janvier": 1, "fev": 2, "fevr": 2, "fevrier": 2, "mars": 3, "avr": 4, "avril": 4, "mai": 5, "juin": 6, "juil": 7, "juillet": 7,
    "aout": 8, "sept": 9, "septembre": 9, "oct": 10, "octobre": 10, "nov": 11, "novembre": 11, "dec": 12, "decembre": 12,
}

# Result units that are accepted as they are.
KNOWN_UNITS = [
    "%", "cm", "fL", "g/dL", "g/l", "g/L", "kg", "mg/dL", "mg/l", "mg/L", "mm[Hg]", "mmol/L", "mUI/L", "ng/ml", "pg/ml", "pg/mL", "pmol/l", "qualitative",
    "10*3/uL", "U/L", "UI/L", "UI/l", "UI/ml", "uU/mL", "µg/dl",
]

# Misread units and what they stand for.
UNIT_REPAIRS = {
    "9": "%", "9.": "%", "9°": "%", "10°3/uL": "10*3/uL", "10°3/uL,": "10*3/uL", "10°3/uL.": "10*3/uL", "mg/d": "mg/dL", "mg/dl": "mg/dL", "mg/dL.": "mg/dL",
    "mg/dl.": "mg/dL", "mUI/l": "mUI/L", "qualitatif": "qualitative", "Qualitatif": "qualitative", "mm{[Hg]": "mm[Hg]", "wml:": "mmol/L",
}

# Labels of lines that are page furniture.
BOILERPLATE = [
    "document_synthetique", "usage_exclusif_pour_tests_ocr", "parsing_retrieval_multimodal", "dossier_patient_synthetique_multimodal", "communicative_health_care_associates",
]

# Words for sexes and kinds of encounter, as labels.
SEXES = {"f": "F", "female": "F", "feminin": "F", "m": "M", "male": "M", "masculin": "M", "masculine": "M"}
ENCOUNTERS = {
    "ambulatory": "Ambulatory", "externe": "External", "wellness": "Wellness", "outpatient": "Outpatient", "inpatient": "Inpatient", "urgence": "Emergency",
    "emergency": "Emergency", "urgent_care": "Urgent care",
}

# Sections of the stool report, and the labels that tell such a report.
STOOL_SECTIONS = {
    "macroscopic_exam": "EXAMEN MACROSCOPIQUE",
    "microscopic_exam": "EXAMEN MICROSCOPIQUE",
    "enrichment_exam": "EXAMEN APRÈS ENRICHISSEMENT",
    "staining_exam": "EXAMEN APRÈS COLORATION",
    "final_result": "RÉSULTAT FINAL",
}
STOOL_MARKERS = ["laboratoire_de_parasitologie_mycologie", "examen_parasitologique_des_selles", "examen_macroscopique", "examen_microscopique", "resultat_final"]

# Parasites, the patterns that name them, and the genus that a species makes redundant.
PARASITES = {
    "ankylostoma duodenale": [r"\bankylostoma\s+duodenale\b", r"\bankylostome\s+duodenale\b"],
    "ankylostoma": [r"\bankylostoma\b", r"\bankylostome\b"],
    "trichuris trichiura": [r"\btrichuris\s+trichiura\b"],
    "trichuris": [r"\btrichuris\b"],
}
GENUS_OF = {"ankylostoma duodenale": "ankylostoma", "trichuris trichiura": "trichuris"}

# Sections that a document must have.
REQUIRED_SECTIONS = ["blocks", "images", "pages", "patient", "report", "results", "tables", "validation_report"]
