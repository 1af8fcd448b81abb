"""Code lists, patterns, weights and labels that results depend on."""

# 47 procedure codes of the cohort.
PROCEDURE_CODES = (
    "44204", "49650", "44970", "45400", "43775", "44202", "47563", "47562",
    "43659", "44180", "44187", "43280", "43644", "49652", "44206", "44207",
    "44615", "49000", "43771", "49654", "44213", "38120", "44188", "49321",
    "45397", "44227", "43281", "44899", "43289", "43279", "49329", "38570",
    "44238", "43620", "43770", "49659", "47379", "38129", "43645", "43284",
    "48999", "49322", "49324", "38571", "43499", "47570", "49323",
)

# Laboratory components: output column -> component ids.
LAB_COMPONENTS = {
    "ALB": ("17517", "123000017517"),
    "HCT": ("45443", "123000045443"),
    "Creat": ("21600", "123000021600"),
    "BUN": ("30940", "123000030940"),
    "NA": ("29512", "123000029512"),
    "SGOT": ("19208", "123000019208"),
    "ALKPhos": ("67686", "123000067686"),
    "BT": ("19752", "123000019752"),
    "APTT": ("31732", "123000031732"),
    "PLT": ("7773", "123000007773"),
    "WBC": ("8045", "123000008045"),
    "INR": ("63016", "123000063016"),
}

# Note types kept: operative or procedure notes, then admission notes.
NOTE_TYPE_CODES = (1000004, 1000000, 1000012, 3, 4, 27, 26)
NOTE_TYPE_ORDER = ("1000000", "27", "1000004", "4", "3", "1000012", "26")

# Comorbidity families by ICD-10 code (regular expressions on the dotted code).
DX_FLAGS = {
    "Diabetes_Dx": "^(E08|E09|E10|E11|E13)",
    "HTN_Dx": "^(I10|I11|I12|I13|I15|I16)",
    "HF_Dx": r"^I50|^(I11\.0|I13\.0|I13\.2)$",
    "COPD_Dx": "^J44",
    "Ascites_Dx": "^R18",
    "DisseminatedCa_Dx": "^(C77|C78|C79)",
    "Bleeding_Dx": "^(D65|D66|D67|D68)",
    "AKI_Dx": "^N17",
    "Dialysis_Dx": r"^(Z99\.2|N18\.6)$",
    "VentDep_Dx": r"^Z99\.11$",
    "Steroid_Dx": r"^(Z79\.52|Z79\.899)$",
}
# Codes that enter the diagnosis history at all.
DX_HISTORY = (r"^(E0[89]|E1[013]|I1[0-6]|I50|J44|R18|C7[789]|D6[5-8]|N17)"
              r"|^(Z99\.2|N18\.6|Z99\.11|Z79\.52|Z79\.899)$")
# The draft variant of the same flags.
DX_FLAGS_DRAFT = {
    "Diabetes_Dx": "^(E08|E09|E10|E11|E13)",
    "HTN_Dx": "^(I10|I11|I12|I13|I15|I16)",
    "HF_Dx": r"^I50|^(I11\.0|I13\.0|I13\.2)$",
    "COPD_Dx": "^J44",
    "Ascites_Dx": "^R18",
    "DisseminatedCa_Dx": r"^(C77|C78|C79|C7B)|^(C80\.0|C80\.1)$",
    "Bleeding_Dx": "^(D65|D66|D67|D68|D69)",
    "AKI_Dx": "^N17",
    "Dialysis_Dx": r"^(Z99\.2|N18\.6)$",
    "VentDep_Dx": r"^Z99\.11$",
}

# Social codes per account.
SOCIAL_FLAGS = {
    "SDOH_Housing_Z": r"^(Z59\.0|Z59\.1)",
    "SDOH_Food_Z": r"^Z59\.4",
    "SDOH_Financial_Z": r"^(Z59\.5|Z59\.6|Z59\.7)",
    "SDOH_Any_Z": "^(Z5[5-9]|Z6[0-5])",
}

# Medication families by generic name in capitals; True marks families that need at least 30 days of use.
MED_FLAGS = {
    "Insulin_Rx": (("INSULIN",), False),
    "Antihypertensive_Rx": (("LISINOPRIL", "ENALAPRIL", "LOSARTAN", "VALSARTAN", "AMLODIPINE", "DILTIAZEM",
                             "HYDROCHLOROTHIAZIDE", "FUROSEMIDE", "METOPROLOL", "CARVEDILOL", "ATENOLOL",
                             "PROPRANOLOL"), False),
    "Immunosuppressant_Rx": (("PREDNISONE", "PREDNISOLONE", "CYCLOSPORINE", "TACROLIMUS", "MYCOPHENOLATE",
                              "AZATHIOPRINE", "METHOTREXATE"), True),
    "Anticoagulant_Rx": (("WARFARIN", "APIXABAN", "RIVAROXABAN", "DABIGATRAN", "EDOXABAN"), True),
}

# Blood product codes (first five characters) that count as red cells.
RED_CELL_CODES = ("E0332", "E0336")

# Admission types that count as unplanned.
UNPLANNED_ADMISSION_TYPES = (3, 7, 8, 13, 14)

# Charlson categories: name, output flag, weight, pattern; the first match wins, so METS and DM_COMP never fire.
CHARLSON = (
    ("MI", "mi", 1, "^(I21|I22)"),
    ("CHF", "chf", 1, "^I50"),
    ("PVD", "pvd", 1, "^(I70|I71|I73|I74)"),
    ("CVD", "cvd", 1, "^(I6[0-9]|G45|G46)"),
    ("DEMENTIA", "dementia", 1, "^(F00|F01|F02|F03|G30)"),
    ("COPD", "copd", 1, "^(J4[0-7]|J6[0-7])"),
    ("RHEUM", "rheum", 1, "^(M05|M06)"),
    ("PUD", "pud", 1, "^(K25|K26|K27|K28)"),
    ("LIVER_MILD", "liver_mild", 1, "^(B18|K70[023]|K71|K73|K74)"),
    ("DM_UNC", "dm_uncomp", 1, "^(E10|E11|E12|E13|E14)"),
    ("HEMI", "hemiplegia", 2, "^(G81|G82)"),
    ("RENAL", "renal", 2, "^(N03[234567]|N05[234567]|N18|N19)"),
    ("DM_COMP", "dm_comp", 2, "^E1[01234][23456789]"),
    ("CANCER", "cancer", 2, "^(C[0-7][0-9]|C8[01234]|C88|C9[0-6])"),
    ("LIVER_SEV", "liver_sev", 3, "^(K70[469]|K72|K76[567])"),
    ("METS", "mets", 6, "^(C77|C78|C79|C80)"),
    ("AIDS", "aids", 6, "^B2[0-4]"),
)

# Surgical departments besides names that start with SURG or contain SURGERY.
SURGICAL_SPECIALTIES = (
    "General Surgery", "Colorectal Surgery", "Vascular Surgery", "Cardiothoracic Surgery", "Plastic Surgery",
    "Bariatric Surgery", "Surgical Oncology", "Trauma Surgery", "Transplant Surgery", "Endocrine Surgery",
    "Breast Surgery", "Otolaryngology", "Urology", "Orthopedic Surgery", "Neurosurgery", "Gynecology",
)

# Provider type -> role.
PROVIDER_ROLES = {
    "Attending": "attending",
    "Physician": "attending",
    "Resident": "resident",
    "Fellow": "resident",
    "Medical Student": "resident",
    "Nurse Anesthetist": "crna",
    "Student Nurse Anesthetist": "crna",
    "Anesthesiologist": "anesth",
    "Physician Assistant": "other",
    "Technician": "other",
    "Perfusionist": "other",
    "Dentist": "other",
}
ROLE_NAMES = ("attending", "resident", "crna", "anesth", "other")

# Order group categories by word in the group body.
LAB_WORDS = ("Lab", "Point of Care", "Microbiology", "Pathology", "Blood Bank")
IMAGING_WORDS = ("Imaging", "EKG")
CONSULT_WORDS = ("Consult",)
REHAB_WORDS = ("SLP", "PT", "OT", "Supplement", "NPO", "Rehab", "Therapy", "Consult", "Referral")

# Unit label -> coarse bucket; anything else is Other.
UNIT_BUCKETS = {
    "ICU": "Intensive",
    "PICU": "Intensive",
    "NICU": "Intensive",
    "Med/Surg": "Acute",
    "Procedural Area": "OR",
    "ED": "ED",
    "Recovery Area": "Intermediate",
}
SEQUENCE_UNITS = ("ED", "Acute", "OR", "Intensive", "Intermediate", "Other")

# Discharge labels left out of the cohort, and their eight groups.
EXCLUDED_DISPOSITIONS = (
    "Expired", "Expired in Medical Facility", "Hospice/Home", "Hospice/Medical Facility",
    "Acute / Short Term Hospital", "Left Against Medical Advice",
)
DISPOSITION_GROUPS = {
    "Home or Self Care": "home",
    "Home-Health Care Svc": "home_health",
    "Skilled Nursing Facility": "snf",
    "Rehab Facility": "rehab",
    "Long Term Care": "rehab",
    "Interim / Custodial Care Facility": "rehab",
    "Hospice/Home": "hospice_exp",
    "Hospice/Medical Facility": "hospice_exp",
    "Expired": "hospice_exp",
    "Expired in Medical Facility": "hospice_exp",
    "Acute / Short Term Hospital": "acute_transfer",
    "Psychiatric Hospital": "acute_transfer",
    "Cancer Center/Children's Hospital": "acute_transfer",
    "Left Against Medical Advice": "ama",
    "Another Health Care Institution Not Defined": "other",
}
HOME_DISPOSITIONS = ("Home or Self Care", "Home-Health Care Svc")

# ASA class in roman numerals; anesthesia technique names.
ROMAN = {"I": "1.0", "II": "2.0", "III": "3.0", "IV": "4.0", "V": "5.0", "VI": "6.0"}
ANESTHESIA_NAMES = {
    "General": "general",
    "Regional": "regional",
    "Spinal": "spinal",
    "Epidural": "epidural",
    "Monitored anesthesia care/IV sedation": "MAC",
}

# Anchor sites (latitude, longitude) and distance limits in miles.
ANCHOR_SITES = {"main": (40.7651, -73.9638), "south": (40.7095, -74.0135)}
FAR_MILES, BAND_MILES = 5.0, 25.0
EARTH_RADIUS_MILES = 3958.8
DISTANCE_BIN_EDGES = (2.0, 5.0, 10.0, 25.0)
NYC_ZIP3 = ("100", "101", "102", "103", "104", "112", "113", "114", "116")
MANHATTAN_ZIP3 = ("100", "101", "102")
HIGH_INCOME_ZIPS = (
    "10007", "10021", "10022", "10023", "10028", "10036", "10065", "10075",
    "10128", "11201", "10011", "10014", "10019", "10024", "10025",
)
LOW_INCOME_ZIPS = (
    "10029", "10035", "10037", "10039", "10451", "10452", "10453", "10454",
    "10455", "10456", "10457", "10458", "10459", "10460", "10467", "10473",
    "10474", "11207", "11208", "11212", "11213", "11221", "11224", "11225",
    "11226", "11233", "11239",
)

# Text patterns, matched without regard to case.
TEXT_PATTERNS = {
    "sdoh_housing": r"\b(homeless|shelter|unstable housing|housing insecurit\w*|eviction)\b",
    "sdoh_food": r"\b(food insecurit\w*|SNAP|food stamps|hungry|malnourish\w*)\b",
    "sdoh_transp": r"\b(no transportation|unable to travel|no ride|no car)\b",
    "sdoh_alcohol": r"\b(alcohol abuse|alcoholism|heavy drink\w*|AUD|delirium tremens|DTs)\b",
    "sdoh_subst": r"\b(substance abuse|drug use|IVDU|opioid abuse|cocaine|methamphetamine)\b",
    "sdoh_social": r"\b(lives alone|no support|no caregiver|widowed|isolated)\b",
    "sdoh_depr": r"\b(depression|depressed|MDD|major depressive|suicide|suicidal)\b",
    "sdoh_anx": r"\b(anxiety|PTSD|panic disorder)\b",
    "sdoh_unempl": r"\b(unemployed|disabled|cannot work)\b",
    "sdoh_insur": r"\b(uninsured|self-pay|Medicaid)\b",
    "sdoh_smoke": r"\b(smoker|tobacco use|pack-year|pack years)\b",
    "sdoh_nonadh": r"\b(non[- ]?compliant|missed appointment|non[- ]?adherent)\b",
    "sdoh_lang": r"\b(interpreter|non[- ]?English speaking|language barrier)\b",
    "med_steroid": r"\b(prednisone|dexamethasone|methylprednisolone|hydrocortisone|steroid)\b",
    "med_immuno": r"\b(tacrolimus|cyclosporine|mycophenolate|azathioprine|sirolimus)\b",
    "med_anticoag": r"\b(warfarin|apixaban|rivaroxaban|dabigatran|heparin|enoxaparin|coumadin|eliquis|xarelto)\b",
    "med_dmard": r"\b(methotrexate|adalimumab|etanercept|infliximab|rituximab)\b",
    "med_insulin": r"\b(insulin|glargine|lantus|humalog|novolog)\b",
    "med_opioid": r"\b(morphine|oxycodone|hydrocodone|fentanyl|percocet|dilaudid|hydromorphone|oxycontin)\b",
    "med_benzo": r"\b(alprazolam|lorazepam|clonazepam|diazepam|xanax|ativan|klonopin|valium)\b",
    "cx_htn": r"\b(hypertension|HTN)\b",
    "cx_dm": r"\b(diabetes|diabetic|DM type|type 2 DM|type 1 DM|T2DM|T1DM)\b",
    "cx_cad": r"\b(coronary artery disease|CAD|MI history|prior MI)\b",
    "cx_afib": r"\b(atrial fibrillation|Afib|A-fib)\b",
    "cx_copd": r"\b(COPD|chronic obstructive pulmonary)\b",
    "cx_chf": r"\b(congestive heart failure|CHF|heart failure|HFrEF|HFpEF)\b",
    "cx_ckd": r"\b(chronic kidney disease|CKD|ESRD|dialysis)\b",
    "cx_cancer": r"\b(cancer|carcinoma|malignancy|adenocarcinoma|neoplasm)\b",
    "cx_obese": r"\b(obesity|obese|BMI \d\d)\b",
    "cx_osa": r"\b(sleep apnea|OSA|CPAP)\b",
    "sev_sepsis": r"\b(sepsis|septic)\b",
    "sev_shock": r"\b(shock)\b",
    "sev_crit": r"\b(critical|unstable|emergent|resuscitat\w*)\b",
}
TEXT_NUMBERS = {
    "note_hb_last": r"\b(?:hemoglobin|hgb|hb)\s*[:=]?\s*(\d{1,2}(?:\.\d)?)",
    "note_cr_last": r"\bcreatinine\s*[:=]?\s*(\d{1,2}(?:\.\d{1,2})?)",
    "note_wbc_last": r"\b(?:wbc|white blood cell)\s*[:=]?\s*(\d{1,3}(?:\.\d{1,2})?)",
}

# Missing-data rates used by the masking ablation.
MASKING_RATES = {"BMI": 0.043, "Height (cm)": 0.043, "ASAClass": 0.017, "MaritalStatus": 0.0211, "CCI": 0.083}

# Columns that leak the outcome of a prolonged stay, and the social block left out of some models.
LEAKY_FEATURES = (
    "Discharge Disposition", "# of Cardiac Arrest Requiring CPR", "# of Stroke/Cerebral Vascular Acccident (CVA)",
    "# of Postop Unplanned Intubation", "preop_los_acute_hr", "preop_los_intensive_hr", "preop_los_intermediate_hr",
    "preop_transfer_count", "preop_n_units",
)
SOCIAL_FEATURES = ("Language", "SDOH_Housing_Z", "SDOH_Food_Z", "SDOH_Financial_Z", "SDOH_Any_Z")

# Column orders of the input extracts.
COHORT_COLUMNS = ("LogID", "EncounterCSN", "PAT_ID", "SurgeryDate", "SurgeryYear", "PrimaryCPT", "AgeYears")
ENCOUNTER_COLUMNS = ("LogID", "EncounterCSN", "PAT_ID", "SurgeryDate", "PrimarySurgID")
PROVIDER_EDGE_COLUMNS = ("LogID", "ProvID", "RoleCode", "RoleSource", "ProviderType")
UNIT_EDGE_COLUMNS = ("LogID", "EncounterCSN", "PAT_ID", "DepartmentID", "DepartmentName", "UnitType",
                     "InstitutionType", "InTime", "OutTime", "Hours", "SeqInEncounter")
PROVIDER_COLUMNS = ("ProvID", "ProvName", "EmployedCRNA", "IsResident", "IsHospitalist", "DoctorsDegree",
                    "ClinicianTitle", "ProvType", "StaffResourceCode", "MCDProfCode", "CaseVolume2yr", "CaseVolume5yr")
UNIT_COLUMNS = ("DepartmentID", "DepartmentName", "Specialty", "InpatientFlag", "ADTUnitTypeCode", "ORUnitTypeCode",
                "IsPeriopDept", "LicensedBeds", "ServiceAreaID", "UnitType", "InstitutionType")
ORDER_COLUMNS = ("LogID", "PAT_ID", "EncounterCSN", "SeqInEncounter", "OrderTime", "OrderSource", "OrderGroup",
                 "MinutesFromPrev")
COMORBIDITY_COLUMNS = ("LogID", "mi", "chf", "pvd", "cvd", "dementia", "copd", "rheum", "pud", "liver_mild",
                       "dm_uncomp", "hemiplegia", "renal", "dm_comp", "cancer", "liver_sev", "mets", "aids",
                       "n_ed_visits_180d", "n_admits_365d")
ID_COLUMNS = ("LogID", "EncounterCSN", "PAT_ID", "ProvID", "PrimarySurgID", "DepartmentID")

# Registry column name -> library column name (the names that differ).
REGISTRY_NAMES = {
    "Age at Time of Surgery": "AgeYears",
    "Sex": "Gender",
    "In/Out-Patient Status": "PatientType",
    "ASA Classification": "ASAClass",
    "Principal Anesthesia Technique": "AnesType",
    "Hospital Discharge Destination": "Discharge Disposition",
    "Height": "Height (cm)",
    "Weight": "Weight (kg)",
    "Duration of Surgical Procedure (in minutes)": "CutToClose",
    "Serum Sodium": "NA",
    "Serum Creatinine": "Creat",
    "Albumin": "ALB",
    "Total Bilirubin": "BT",
    "AST/SGOT": "SGOT",
    "Alkaline Phosphatase": "ALKPhos",
    "Hematocrit": "HCT",
    "Platelet Count": "PLT",
    "PTT": "APTT",
}
