"""Built-in rule packs, as data.

A row is (id, kind, category, action, pattern); kind R is a regular expression, D a dictionary term, H a name heuristic
and S a heuristic that skips sentence starts.
"""

# ruff: noqa: E501

# Detection patterns whose results must agree with published rule packs.
PACKS: dict[str, tuple[tuple[str, str, str, str, str], ...]] = {
    "base": (
        ("us_ssn", "R", "IdentificationNumber", "Redact", r'\d{3}[.\-\s]*\d{2}[.\-\s]*\d{4}'),
        ("euro_iban", "R", "FinancialData", "Redact", r'[A-Z]{2}\d{2}[A-Z0-9]{11,30}'),
        ("client_names", "D", "IndividualName", "Redact", 'Alice'),
        ("internal_projects", "D", "InternalAsset", "Redact", 'Project Alpha'),
        ("company_secrets", "D", "InternalAsset", "Redact", 'Acme Corp'),
        ("credit_card", "R", "FinancialData", "Redact", r'\d{4}[.\-\s]*\d{4}[.\-\s]*\d{4}[.\-\s]*\d{4}'),
        ("email_address", "R", "ContactInfo", "Redact", r'[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'),
        ("phone_number", "R", "ContactInfo", "Redact", r'\b\d{3}[.\-\s]*\d{3}[.\-\s]*\d{4}\b'),
        ("test_secrets", "R", "InternalAsset", "Redact", 'Secret[A-Z]'),
        ("github_token", "R", "InternalAsset", "Redact", r'\bgh[pousr]_[A-Za-z0-9_]{36,255}\b'),
        ("openai_or_stripe_key", "R", "InternalAsset", "Redact", r'\b(?:sk-(?:proj-)?[A-Za-z0-9_\-]{20,}|rk_live_[A-Za-z0-9]{24,})\b'),
        ("aws_access_key_id", "R", "InternalAsset", "Redact", r'\b(?:AKIA|ASIA)[0-9A-Z]{16}\b'),
        ("slack_token", "R", "InternalAsset", "Redact", r'\bxox[baprs]-[0-9A-Za-z\-]{10,}\b'),
        ("bearer_jwt", "R", "InternalAsset", "Redact", r'\bey[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}(?:\.[A-Za-z0-9_\-]{10,})?\b'),
        ("gr_afm", "R", "IdentificationNumber", "Redact", r'\b\d{9}\b'),
        ("gr_amka", "R", "IdentificationNumber", "Redact", r'\b(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])\d{2}\d{5}\b'),
        ("POTENTIAL_GREEK_NAME", "S", "IndividualName", "Redact", r'\b[Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώϊϋΐΰ]+(?:ης|ου|ος|ας|α|ων|η)\b'),
        ("HONORIFIC_PERSON_NAME", "H", "IndividualName", "Redact", r'\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Rev|Hon)\.?\s+[A-ZΑ-ΩΆΈΉΊΌΎΏ][a-zα-ωάέήίόύώϊϋΐΰ]{2,}\b'),
    ),
    "legal": (
        ("gr_afm", "R", "IdentificationNumber", "Redact", r'\b[0-9]{9}\b'),
        ("gr_amka", "R", "IdentificationNumber", "Redact", r'\b(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])\d{2}\d{5}\b'),
        ("eu_iban", "R", "FinancialData", "Redact", r'[A-Z]{2}\d{2}[A-Z0-9]{11,30}'),
        ("case_id", "R", "InternalAsset", "Redact", r'\bLAW-[0-9]{4}-[A-Z0-9]+\b'),
        ("attorney_bar_number", "R", "IdentificationNumber", "Redact", r'(?i)\b(?:BAR|Bar Number:?)[.\-\s]*\d{5,8}\b'),
        ("court_case_docket", "R", "InternalAsset", "Redact", r'(?i)\b\d{2,4}-[a-z]{2,4}-\d{4,6}\b'),
        ("confidential_marker", "R", "InternalAsset", "Redact", r'(?i)\b(?:CONFIDENTIAL|ATTORNEY-CLIENT PRIVILEGE|SUBJECT TO NDA|WORK PRODUCT)\b'),
        ("gr_phone", "R", "ContactInfo", "Redact", r'\b(2[0-9]{9}|69[0-9]{8})\b'),
        ("gr_postal", "R", "ContactInfo", "Redact", r'\b[1-8][0-9]{4}\b'),
        ("POTENTIAL_CLIENT_NAME", "S", "IndividualName", "Redact", r"\b[A-Z\u0391-\u03A9][a-z\u03B1-\u03C9\u03AC-\u03CE]+(?:[ \-'](?:da|de|del|von|van|Ibn|ibn|al|bin|[A-Z\u0391-\u03A9]\.)[ \-']?)?(?:[ \-'][A-Z\u0391-\u03A9][a-z\u03B1-\u03C9\u03AC-\u03CE]+)+\b"),
    ),
    "medical": (
        ("medical_record_number", "R", "IdentificationNumber", "Redact", r'(?i)\b(?:MRN|MR)[.\-\s]*\d{4,10}\b'),
        ("national_provider_identifier", "R", "IdentificationNumber", "Redact", r'\b[12]\d{9}\b'),
        ("medicare_mbi", "R", "IdentificationNumber", "Redact", r'(?i)\b[1-9][a-z0-9]{2}[0-9][a-z0-9]{2}[0-9][a-z0-9]{2}[0-9]{2}\b'),
        ("prescription_number", "R", "IdentificationNumber", "Redact", r'(?i)\b(?:RX|Rx|Prescription)[.\-\s]*\d{5,12}\b'),
        ("icd10_code", "R", "InternalAsset", "Redact", r'(?i)\b[a-z]\d{2}(?:\.\d{1,4})?\b'),
        ("POTENTIAL_DISEASE", "H", "Other", "AuditOnly", r'(?i)\b(?:diabetes|cancer|leukemia|asthma|hypertension|covid-19|influenza|depression|anxiety|dementia|alzheimer|arthritis|cardiovascular disease|tuberculosis)\b'),
        ("POTENTIAL_DRUG_NAME", "H", "Other", "AuditOnly", r'(?i)\b(?:Lipitor|Synthroid|Humira|Keytruda|Revlimid|Eliquis|Imbruvica|Stelara|Eylea|Biktarvy|Xarelto|Opdivo|Prevnar|Neulasta|Prolia|Enbrel|Soliris|Lantus|Ibrance|Neulasta|Adalimumab|Atorvastatin|Levothyroxine|Metformin|Lisinopril|Amlodipine|Albuterol|Gabapentin|Sertraline|Omeprazole)\b'),
    ),
    "shipping": (
        ("bill_of_lading", "R", "Organization", "Redact", r'\b(?:[A-Z]{4}[0-9A-Z]{8,12}|BOL-\d{8}-[A-Z]{2})\b'),
        ("customs_id", "R", "IndividualName", "Redact", r'\b(?:CUST-[A-Z]{3}-\d{6}|[A-Z]{2}\d{9,12})\b'),
        ("tracking_manifest", "R", "Other", "Redact", r'\b(?:TRK-\d{10}|[A-Z0-9]{10,20})\b'),
        ("container_id", "R", "Organization", "Redact", r'\b[A-Z]{4}\d{7}\b'),
        ("imo_number", "R", "Organization", "Redact", r'\bIMO\s?\d{7}\b'),
        ("air_waybill", "R", "InternalAsset", "Redact", r'\b\d{3}-\d{8}\b'),
        ("hs_tariff_code", "R", "InternalAsset", "Redact", r'\b\d{4}\.\d{2}(?:\.\d{2})?\b'),
        ("commercial_invoice", "R", "InternalAsset", "Redact", r'(?i)\b(?:INV|INVOICE)-\d{5,10}\b'),
        ("POTENTIAL_VESSEL_NAME", "S", "IndividualName", "Redact", r'\b(?:MV|SS|RV|MS|CV) [A-Z][a-zA-Z]+(?: [A-Z][a-zA-Z]+)?\b'),
        ("LOGISTICS_LOCATION", "H", "Location", "Redact", r'\b(?:Port of|Terminal|Berth) [A-Z][a-zA-Z]+\b'),
    ),
    "india": (
        ("in_pan", "R", "IdentificationNumber", "Redact", r'\b[A-Z]{5}[0-9]{4}[A-Z]\b'),
        ("in_aadhaar", "R", "IdentificationNumber", "Redact", r'\b[2-9]\d{3}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}\b'),
        ("in_gstin", "R", "IdentificationNumber", "Redact", r'\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b'),
        ("in_passport", "R", "IdentificationNumber", "Redact", r'\b[A-PR-WYa-pr-wy][1-9]\d{6}\b'),
        ("in_voter_id", "R", "IdentificationNumber", "Redact", r'\b[A-Z]{3}[0-9]{7}\b'),
        ("in_phone", "R", "ContactInfo", "Redact", r'\b(?:(?:\+91|0)[\s\-]?)?[6-9]\d{9}\b'),
        ("POTENTIAL_INDIAN_NAME", "H", "PotentialHeuristic", "Redact", r'\b(?:Shri|Smt|Kumar|Singh|Sharma|Patel|Gupta|Verma|Rao|Reddy|Nair|Pillai|Iyer|Iyengar|Mukherjee|Chatterjee|Banerjee|Das|Ghosh)\b'),
    ),
    "europe": (
        ("eu_iban", "R", "FinancialData", "Redact", r'\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b'),
        ("eu_vat", "R", "FinancialData", "Redact", r'\b[A-Z]{2}[0-9A-Z]{8,12}\b'),
        ("eu_passport", "R", "IdentificationNumber", "Redact", r'\b[A-Z0-9]{9}\b'),
        ("eu_driving_license", "R", "IdentificationNumber", "Redact", r'\b[A-Z0-9]{8,12}\b'),
        ("POTENTIAL_EU_NAME", "S", "PotentialHeuristic", "Redact", r'\b[A-Z\u00C0-\u017E][a-z\u00E0-\u017F]+(?:\s+[A-Z\u00C0-\u017E][a-z\u00E0-\u017F]+)+\b'),
    ),
    "middle_east": (
        ("uae_emirates_id", "R", "IdentificationNumber", "Redact", r'\b784[-\s]?[0-9]{4}[-\s]?[0-9]{7}[-\s]?[0-9]\b'),
        ("saudi_national_id", "R", "IdentificationNumber", "Redact", r'\b[12][0-9]{9}\b'),
        ("saudi_iban", "R", "FinancialData", "Redact", r'\bSA[0-9]{2}[0-9A-Z]{20}\b'),
        ("uae_iban", "R", "FinancialData", "Redact", r'\bAE[0-9]{2}[0-9A-Z]{19}\b'),
        ("qatar_id", "R", "IdentificationNumber", "Redact", r'\b[23][0-9]{10}\b'),
        ("gcc_phone", "R", "ContactInfo", "Redact", r'(?:\+966|00966)[\s\-]?[5]\d{8}|(?:\+971|00971)[\s\-]?[5]\d{8}|(?:\+974|00974)[\s\-]?[3567]\d{7}|\b05\d{8}\b'),
        ("POTENTIAL_ARABIC_NAME", "H", "PotentialHeuristic", "Redact", r'\b(?:عبد\s*|بن\s+|ابن\s+|آل\s+)[\u0621-\u064A\u0671-\u06D3]+\b'),
    ),
    "east_asia": (
        ("cn_resident_id", "R", "IdentificationNumber", "Redact", r'\b[1-9]\d{5}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b'),
        ("cn_uscc", "R", "IdentificationNumber", "Redact", r'\b[0-9A-HJ-NPQRTUWXY]{2}\d{6}[0-9A-HJ-NPQRTUWXY]{10}\b'),
        ("cn_mobile", "R", "ContactInfo", "Redact", r'\b(?:(?:\+86|0086)[\s\-]?)?1[3-9]\d{9}\b'),
        ("jp_my_number", "R", "IdentificationNumber", "Redact", r'\b[1-9]\d{11}\b'),
        ("kr_rrn", "R", "IdentificationNumber", "Redact", r'\b\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[\s\-]?[1-4]\d{6}\b'),
        ("sg_nric", "R", "IdentificationNumber", "Redact", r'\b[STFGMstfgm]\d{7}[A-Za-z]\b'),
        ("POTENTIAL_EAST_ASIAN_NAME", "H", "PotentialHeuristic", "Redact", r'[\u4E00-\u9FFF\u3040-\u309F\u30A0-\u30FF\uAC00-\uD7AF]{2,4}'),
    ),
    "greek": (
        ("gr_afm", "R", "Other", "Redact", r'\b\d{9}\b'),
        ("gr_amka", "R", "Other", "Redact", r'\b(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])\d{2}\d{5}\b'),
        ("POTENTIAL_GREEK_NAME", "S", "IndividualName", "Redact", r'\b[Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώϊϋΐΰ]+(?:ης|ου|ος|ας|α|ων|η)\b'),
    ),
    "core": (
        ("us_ssn", "R", "Other", "Redact", r'\b\d{3}[.\-\s]*\d{2}[.\-\s]*\d{4}\b'),
        ("euro_iban", "R", "Other", "Redact", r'\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b'),
        ("credit_card", "R", "Other", "Redact", r'\b\d{4}[.\-\s]*\d{4}[.\-\s]*\d{4}[.\-\s]*\d{4}\b'),
        ("email_address", "R", "Other", "Redact", r'\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b'),
        ("client_names", "D", "Other", "Redact", 'Alice'),
        ("internal_projects", "D", "Other", "Redact", 'Project Alpha'),
        ("company_secrets", "D", "Other", "Redact", 'Acme Corp'),
        ("POTENTIAL_NAME", "S", "Other", "Redact", r'\b[A-Z][a-z]+\b'),
        ("POTENTIAL_DATE", "H", "Other", "Redact", r'\b(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b'),
        ("POTENTIAL_UUID", "H", "Other", "Redact", r'\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b'),
        ("POTENTIAL_ID", "H", "Other", "Redact", r'\b\d{3}[.\-\s]*\d{2}[.\-\s]*\d{4}\b|\b[A-Z0-9]{8,20}\b'),
    ),
    "demo": (
        ("gr_afm", "R", "Other", "Redact", r'\b[0-9]{9}\b'),
        ("confidential_project", "R", "Other", "Block", '(?i)Project (Alpha|Omega|Zion)'),
        ("POTENTIAL_NAME", "S", "Other", "Redact", r'\b[A-Z\u0386\u0388-\u038A\u038C\u038E\u038F\u0391-\u03A9][\u03B1-\u03C9\u03AC-\u03CEa-z]+\b'),
    ),
    "block_test": (
        ("block_test_keyword", "D", "InternalAsset", "Block", 'BLOCK_TEST_KEYWORD'),
        ("email_address", "R", "ContactInfo", "Redact", r'[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'),
    ),
    "hipaa": (
        ("hipaa_mrn", "R", "IdentificationNumber", "Redact", r'(?i)\b(?:MRN|MR|Record#|Medical\s*Record)[.:\-\s]*[A-Z0-9]{4,12}\b'),
        ("hipaa_npi", "R", "IdentificationNumber", "Redact", r'\b[12]\d{9}\b'),
        ("hipaa_medicare_mbi", "R", "IdentificationNumber", "Redact", r'(?i)\b[1-9][a-z0-9]{2}[0-9][a-z0-9]{2}[0-9][a-z0-9]{2}[0-9]{2}\b'),
        ("hipaa_ssn", "R", "IdentificationNumber", "Redact", r'\b\d{3}[.\-\s]*\d{2}[.\-\s]*\d{4}\b'),
        ("hipaa_dea_number", "R", "IdentificationNumber", "Redact", r'(?i)\b[A-Z]{2}\d{7}\b'),
        ("hipaa_prescription_number", "R", "IdentificationNumber", "Redact", r'(?i)\b(?:RX|Rx|Prescription)[.:\-\s]*\d{5,12}\b'),
        ("hipaa_health_plan_id", "R", "IdentificationNumber", "Redact", r'(?i)\b(?:HMO|PPO|INS|PLAN|POL)[.:\-\s]*[A-Z0-9]{6,16}\b'),
        ("hipaa_email", "R", "ContactInfo", "Redact", r'\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b'),
        ("hipaa_phone", "R", "ContactInfo", "Redact", r'\b(?:\+?1[-.\s]?)?\(?[2-9]\d{2}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b'),
        ("POTENTIAL_DIAGNOSIS_ICD", "H", "Other", "Redact", r'(?i)\b[A-TV-Z][0-9][0-9AB](?:\.[0-9A-KXZ]{1,4})?\b'),
        ("POTENTIAL_MEDICATION", "H", "Other", "Redact", r'(?i)\b(?:Lipitor|Synthroid|Humira|Keytruda|Eliquis|Imbruvica|Stelara|Biktarvy|Xarelto|Opdivo|Adalimumab|Atorvastatin|Levothyroxine|Metformin|Lisinopril|Amlodipine|Albuterol|Gabapentin|Sertraline|Omeprazole|Oxycodone|Fentanyl|Morphine|Hydrocodone|Adderall|Xanax)\b'),
    ),
    "gdpr": (
        ("gdpr_iban", "R", "FinancialData", "Redact", r'\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b'),
        ("gdpr_passport", "R", "IdentificationNumber", "Redact", r'(?i)\b(?:Passport[.:\-\s]*)?[A-Z0-9]{8,9}\b'),
        ("gdpr_national_id", "R", "IdentificationNumber", "Redact", r'\b\d{2,3}[.\-\s]*\d{2,3}[.\-\s]*\d{2,4}[.\-\s]*[A-Z0-9]?\b'),
        ("gdpr_email", "R", "ContactInfo", "Redact", r'\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b'),
        ("gdpr_phone", "R", "ContactInfo", "Redact", r'\b(?:\+\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b'),
        ("gdpr_ipv4", "R", "Other", "Redact", r'\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b'),
        ("POTENTIAL_PERSON_NAME", "H", "IndividualName", "Redact", r'\b[A-Z][a-z]{2,}\s+[A-Z][a-z]{2,}\b'),
        ("POTENTIAL_POSTAL_ADDRESS", "H", "Location", "Redact", r'(?i)\b\d{1,5}\s+(?:[A-Z][a-z]+\s+)+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Weg|Str|Strasse|Rue)\b'),
    ),
    "pci_dss": (
        ("pci_visa", "R", "FinancialData", "Redact", r'\b4\d{3}[.\-\s]?\d{4}[.\-\s]?\d{4}[.\-\s]?\d{4}\b'),
        ("pci_mastercard", "R", "FinancialData", "Redact", r'\b(?:5[1-5]\d{2}|222[1-9]|22[3-9]\d|2[3-6]\d{2}|27[01]\d|2720)[.\-\s]?\d{4}[.\-\s]?\d{4}[.\-\s]?\d{4}\b'),
        ("pci_amex", "R", "FinancialData", "Redact", r'\b3[47]\d{2}[.\-\s]?\d{6}[.\-\s]?\d{5}\b'),
        ("pci_discover", "R", "FinancialData", "Redact", r'\b6(?:011|5\d{2}|4[4-9]\d)[.\-\s]?\d{4}[.\-\s]?\d{4}[.\-\s]?\d{4}\b'),
        ("pci_generic_pan", "R", "FinancialData", "Redact", r'\b(?:\d{4}[.\-\s]?){3}\d{4}\b'),
        ("pci_cvv", "R", "FinancialData", "Redact", r'(?i)\b(?:CVV|CVC|CID|CVV2|CVC2|Security\s*Code)[.:\-\s]*\d{3,4}\b'),
        ("pci_card_expiry", "R", "FinancialData", "Redact", r'(?i)\b(?:Exp|Expiry|Expires|VALID\s*THRU)[.:\-\s]*(?:0[1-9]|1[0-2])[\/\-]\d{2,4}\b'),
        ("pci_aba_routing", "R", "FinancialData", "Redact", r'(?i)\b(?:Routing|ABA|RTN)[.:\-\s]*\d{9}\b'),
        ("POTENTIAL_ACCOUNT_NUMBER", "H", "FinancialData", "Redact", r'(?i)\b(?:Acct|Account|Checking|Savings)[.:\-\s#]*\d{8,17}\b'),
    ),
}

# Rules that every engine has.
NATIVE = (
    ("NATIVE_GR_AMKA", "R", "IdentificationNumber", "Redact", r"\b(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])\d{2}\d{5}\b"),
    ("NATIVE_GR_ID", "R", "IdentificationNumber", "Redact", r"\b[Α-ΩA-Z]{2}[- ]?\d{6}\b"),
    ("NATIVE_GR_PHONE", "R", "ContactInfo", "Redact", r"\b(?:(?:\+30|0030)[\s\-]?)?(?:2\d{9}|69\d{8})\b"),
)

#: The packs that are on unless others are asked for.
ACTIVE = ("base", "legal", "medical", "shipping", "india", "europe", "middle_east", "east_asia")
