"""Fixed values of the inspection domain.  Everything here must equal the published code lists."""

# Scope-severity letters that mark a severe citation.
SEVERE_LETTERS = ("J", "K", "H", "I", "F", "L")

# State codes outside the contiguous states.
NON_CONTIGUOUS_STATES = ("02", "15", "78", "74", "72", "69", "66", "60")

# Population 65+ variables, race groups A-G, men 014-016, women 029-031.
SENIOR_VARIABLES = (
    "B01001A_014", "B01001A_015", "B01001A_016", "B01001A_029", "B01001A_030", "B01001A_031",
    "B01001B_014", "B01001B_015", "B01001B_016", "B01001B_029", "B01001B_030", "B01001B_031",
    "B01001C_014", "B01001C_015", "B01001C_016", "B01001C_029", "B01001C_030", "B01001C_031",
    "B01001D_014", "B01001D_015", "B01001D_016", "B01001D_029", "B01001D_030", "B01001D_031",
    "B01001E_014", "B01001E_015", "B01001E_016", "B01001E_029", "B01001E_030", "B01001E_031",
    "B01001F_014", "B01001F_015", "B01001F_016", "B01001F_029", "B01001F_030", "B01001F_031",
    "B01001G_014", "B01001G_015", "B01001G_016", "B01001G_029", "B01001G_030", "B01001G_031",
)

# lon/lat window of the Florida map.
FLORIDA_BOX = {"lon": (-87.634938, -80.031362), "lat": (23.523096, 31.000888)}

# Fixed value: 97.5 % point of the standard normal.
NORMAL_975 = 1.959963984540054

# First and last inspection year kept at ingest.
INGEST_YEARS = (2014, 2023)

# Prefixes of extract columns that are not analysed.
UNUSED_PREFIXES = ("Footnote", "Performance", "Baseline", "cycle", "CYCLE")

# Extract columns dropped at ingest.
INGEST_DROPS = ("inspection_text", "IDR", "IIDR", "complaint", "standard")

# Descriptive columns dropped from the combined extract.
EXTRACT_DROPS = ("address", "facility_name", "phone", "inspection_text")

# Rating columns dropped before the category study.
RATING_DROPS = (
    "overall_rating", "overall_rating_fn", "survey_rating", "survey_rating_fn", "quality_rating", "quality_rating_fn",
    "ls_quality_rating", "ls_quality_rating_fn", "ss_quality_rating", "ss_quality_rating_fn", "staffing_rating",
    "staffing_rating_fn", "rn_staffing_rating", "rn_staffing_rating_fn",
)

# Extract columns that must be numeric.
NUMERIC_COLUMNS = (
    "cmplnt_cnt", "fine_cnt", "fine_tot", "payden_cnt", "tot_penlty_cnt",
    "aidhrd", "vochrd", "rnhrd", "totlichrd", "tothrd", "pthrd", "incident_cnt",
    "snf vbp ranking", "achievement score", "improvement score",
    "incentive payment multiplier", "bedcert", "restot", "deficiency_tag",
)

# 2019 provider column names and their later long names.
PROVIDER_LONG_NAMES = {
    "PROVNUM": "Federal Provider Number",
    "OWNERSHIP": "Ownership Type",
    "BEDCERT": "Number of Certified Beds",
    "RESTOT": "Average Number of Residents per Day",
    "CERTIFICATION": "Provider Type",
    "INHOSP": "Provider Resides in Hospital",
    "CHOW_LAST_12MOS": "Provider Changed Ownership in Last 12 Months",
    "RESFAMCOUNCIL": "With a Resident and Family Council",
    "AIDHRD": "Reported Nurse Aide Staffing Hours per Resident per Day",
    "VOCHRD": "Reported LPN Staffing Hours per Resident per Day",
    "RNHRD": "Reported RN Staffing Hours per Resident per Day",
    "SURVEY_RATING": "Overall Rating",
    "TOTLICHRD": "Reported Licensed Staffing Hours per Resident per Day",
    "TOTHRD": "Reported Total Nurse Staffing Hours per Resident per Day",
    "CM_AIDE": "Case-Mix Nurse Aide Staffing Hours per Resident per Day",
    "ADJ_TOTAL": "Adjusted Total Nurse Staffing Hours per Resident per Day",
    "CM_LPN": "Case-Mix LPN Staffing Hours per Resident per Day",
    "CM_RN": "Case-Mix RN Staffing Hours per Resident per Day",
    "CM_TOTAL": "Case-Mix Total Nurse Staffing Hours per Resident per Day",
    "ADJ_AIDE": "Adjusted Nurse Aide Staffing Hours per Resident per Day",
    "ADJ_LPN": "Adjusted LPN Staffing Hours per Resident per Day",
    "ADJ_RN": "Adjusted RN Staffing Hours per Resident per Day",
    "WEIGHTED_ALL_CYCLES_SCORE": "Total Weighted Health Survey Score",
    "INCIDENT_CNT": "Number of Facility Reported Incidents",
    "CMPLNT_CNT": "Number of Substantiated Complaints",
    "FINE_CNT": "Number of Fines",
    "FINE_TOT": "Total Amount of Fines in Dollars",
    "PAYDEN_CNT": "Number of Payment Denials",
    "TOT_PENLTY_CNT": "Total Number of Penalties",
    "FILEDATE": "Processing Date",
}

# The identifier column of the 2023 files.
PROVIDER_2023_NAMES = {"CMS Certification Number (CCN)": "Federal Provider Number"}

# Predictors of the tag-count regression, besides the coded state.
REGRESSION_NUMERIC = (
    "severe_tags_applied", "fac_times_inspected", "count_nh_insp_st_yr", "bedcert",
    "restot", "aidhrd", "vochrd", "rnhrd", "cm_aide", "cm_lpn", "cm_rn",
)
REGRESSION_CATEGORICAL = ("ownership", "resfamcouncil")
