"""Values fixed by the expected output: patterns, word lists and texts that must be as they are for right results."""

# Fixed: what a block, a page or a line must look like to be dropped or changed.
MIN_BLOCK_CHARS, MARGIN, EMPTY_SHARE = 10, 0.05, 0.3
CITATION = r"\d{4}\s*;\s*\d+\s*[:(/]*"
LINK = "doi|http"
NUMBERED = r"^[a-zA-Z].*[\s.\-·…\t]{2,}\d{1,4}\s*$"
LEADER = r"[.\-·…]{5,}"
SHORT_NAME = r"^[A-Z][A-Z0-9\-]{1,9}\s*$"
REFERENCE_NUMBER = r"(?<=[a-zA-Z\)\.,])\d+(?:[,\-–]\d+)*"
CAPTION = r"(?i)^\s*(Figure|Fig\.|Table|Supplementary|Recommendation Table)\s*+\d+"

# Fixed: how lines are merged and sentences cut.
HYPHENS, STOPS = "-–­", ".:;?!,"
OVERSIZED = r"(?<=[;:!?])\s+"
DIARY = r"(?<=[.])\s+|(?=\n\s*-)"

# Fixed: what a term is.
TERM = "[a-zA-Z0-9µ²³]+(?:[-/][a-zA-Z0-9µ²³]+)*"
LOWERED_DIGITS, RAISED_DIGITS = "₀₁₂₃₄₅₆₇₈₉", "⁰¹²³⁴⁵⁶⁷⁸⁹"

# Fixed: the parts of a note.
DEMOGRAPHICS = r"(?i)^[^,]+,\s*(?:(\d+)\s*(?:years?\s*old|aa))?\s*(?:(\d+)\s*months?)?"
SECTIONS = {
    "medical_history": ("Pathological proximate", "Remote pathology"),
    "remote_medical_history": ("Remote pathology", "Objective examination"),
    "exams": ("Objective examination", "Clinical Diary"),
    "clinical_diary": ("(?:Clinical record|Clinical diary)", "Diagnosis"),
    "diagnosis": ("Diagnosis", "Prognosis"),
}
LAST_SECTION = "Prognosis"

# Fixed: words that negate, and how far they are looked for.
NEGATIONS = "no|not|none|neither|never|nor|without|absent|absence of|denies|denied|deny|negative|rule[sd]? out|exclude[sd]?"
NEGATED_AFTER = "negatives?"
BEFORE, AFTER = 40, 15

# Fixed: types of entities in the order of their queries, and what each query ends in.
ANCHORS = [
    ("DISEASE_DISORDER", "diagnosis comorbidities risk factors management"),
    ("MEDICATION", "therapy recommendations pharmacological management dosage clinical scores diagnostic evaluation"),
    ("DIAGNOSTIC_PROCEDURE", "findings results clinical course management"),
]

# Fixed: words of a prognosis that choose the template of an admission, and the banner before a reference text.
ADMISSION_WORDS = ("hospitalisation", "hospitalization", "admission", "admitted", "urgent hospitalisation")
BANNER = "\n\n" + "=" * 60 + "\nORIGINAL RECOMMENDATIONS (for comparison)\n" + "=" * 60 + "\n"
