"""Word lists and patterns of the classification rules."""

# Results depend on these lists word by word.
INDIA = r"(?i)\b(?:india|indian|andhra pradesh|arunachal pradesh|assam|bihar|chhattisgarh|goa|gujarat|haryana|himachal pradesh|jharkhand|karnataka|kerala|madhya pradesh|maharashtra|manipur|meghalaya|mizoram|nagaland|odisha|punjab|rajasthan|sikkim|tamil nadu|telangana|tripura|uttar pradesh|uttarakhand|west bengal|delhi|new delhi|ncr|bengaluru|bangalore|gurugram|gurgaon|mumbai|pune|hyderabad|chennai|noida|kolkata|ahmedabad|jaipur|kochi|cochin|thiruvananthapuram|trivandrum|vadodara|baroda|lucknow|chandigarh|indore|bhubaneswar|mysuru|mysore)\b"
UNCERTAIN_REGION = r"(?i)\b(?:remote|apac|asia|south asia|multiple locations?|hybrid)\b"
OTHER_COUNTRY = r"(?i)\b(?:united kingdom|uk|england|london|united states|usa|new york|canada|toronto|singapore|hong kong|australia|sydney|germany|frankfurt|ireland|dublin|poland|warsaw|philippines|manila|malaysia|kuala lumpur|uae|dubai)\b"
CONCEPTS = (
    r"(?i)\bfp&a\b",
    r"(?i)\bfinancial planning(?: and| &) analysis\b",
    r"(?i)\b(?:finance|financial|accounting|audit|assurance|tax|treasury|controllership|controller)\b",
    r"(?i)\b(?:investment banking|equity research|credit research|ratings?|valuation|m&a|mergers? and acquisitions?|capital markets?|asset management|wealth management|private credit|private equity)\b",
    r"(?i)\b(?:securities|derivatives?|fixed income|equities|pricing|underwriting|trading|trade support)\b",
    r"(?i)\b(?:fund accounting|fund administration|middle office|reconciliation|settlements?|collateral|portfolio reporting|investment operations|financial operations)\b",
    r"(?i)\b(?:credit risk|market risk|operational risk|risk management|financial controls?|internal controls?|sox controls?|regulatory controls?|regulatory reporting|financial compliance|regulatory compliance|trade compliance|aml|kyc|sanctions?|financial crime|trade monitoring|model validation)\b",
    r"(?i)\b(?:transaction services|financial due diligence|restructuring|deals?|corporate development|financial advisory)\b",
)
LIKELY = r"(?i)\b(?:banking|investments?|markets?|portfolio|risk|regulatory|credit|economics|commerce|cfa|chartered accountant|ca|mba|pgdm)\b"
OTHER_FIELD_TITLE = r"(?i)(?:\b(?:software|java|python|javascript|typescript|golang|full[ -]?stack|developer|dev|programmer|engineer(?:ing)?|cloud|devops|cybersecurity|information technology|technology|technical support|network(?:ing)?|database administrator|data scientist|machine learning|artificial intelligence|frontend|backend|it quality|quality engineering|application development|systems? analyst|travel manager|human resources|hr|recruiter|talent acquisition|marketing|public relations|communications|legal|counsel|facilities|real estate|event manager|supply chain|logistics|procurement|nurse|security guard|sales|business development|customer success|customer service|customer support|account manager|product manager|product owner|product designer|designer|design|creative|brand|visual|recruitment|administrative|environmental|health and safety|ehs|safety)\b|\bui\b|\bux\b)"
NOISE_TITLE = r"(?i)(?:\b(?:tele ?caller|telesales|collections|loan recovery|recovery agent|growth management|dgm|voice ?over|voice of customer|voc|content (?:creator|strategy)|customer experience|campaign operations|admin ?& operations|administrative assistant|helpdesk|vendor onboarding|personal assistant|executive assistant|talent management|human capital|tech ops|strats|chat process|digital analyst|digitalization|digital operations|digital client services|product delivery|product operations|demand planner|replenishment planner|computational|data science researcher|media analytics|information management|data management|data governance|data strategy|quality analyst|test analyst|testing|sap|abap|employee central|enterprise apps|architect|itsm|itam|servicenow|hardware asset management|identity and access management|digital privacy|digigov|request for proposal|vendor management|performance & reward|reward analyst|security specialist|aiml|agentic|intelligence automation|automation|sapco|ofsaa|epm|video)\b|\boracle (?:epm|ofsaa|cloud|fusion)\b|\bai\s*/\s*ml\b|\bapplied ai\b|\bqa\b|\bccm\b)"
SENIOR_TITLE = r"(?i)(?:\b(?:senior specialist|senior accountant|senior consultant|senior quantitative|senior product|senior member|senior internal auditor|senior executive|senior business analyst|managing consultant|team leader|people leader|deputy manager|vice president|vp|avp|svp|assistant vice president|senior vice president|managing director|executive director|associate director|director|head of|chief [a-z]+ officer|partner|principal|senior manager|lead manager|group manager|assistant manager|senior analyst|senior associate|lead analyst|manager|team lead|mgr)\b|\b(?:dm\s*/\s*am\s*/\s*se)\b|\bsr\.?\s+(?:analyst|associate|specialist|accountant|consultant|manager|quality|product)\b|\blead\b)"
GARBAGE_TITLE = r"(?i)^(?:about the team|responsibilities|qualifications|india|team member|german,? ?nct|csg laf|prospect application for future jobs|all positions in)$"
OTHER_FIELD_CATEGORY = r"(?i)\b(?:technology|information technology|it|engineering|software development|application development|cybersecurity|quality engineering|data science|sales|business development|customer success|customer service|human resources|marketing|legal|product management|procurement)\b"
GENERAL_APPLICATION = r"(?i)\b(?:general,? exploratory application|without specifying a role|all positions in|prospect application for future jobs)\b"
EMPLOYER_BOILERPLATE = r"(?i)\b(?:financial services?(?: industry)?|banking industry)\b"
DOMAIN_METADATA = r"(?i)\b(?:finance|financial|fp&a|financial planning|account(?:ing|s)?|audit|assurance|tax|treasury|controller|controllership|investment|banking|equity|credit|ratings?|valuation|m&a|mergers? and acquisitions?|capital markets?|asset management|wealth|private credit|private equity|securities|derivatives?|fixed income|pricing|underwriting|trading|trade support|fund administration|fund accounting|middle office|reconciliation|settlements?|collateral|portfolio reporting|risk|regulatory reporting|financial compliance|regulatory compliance|trade compliance|aml|kyc|sanctions?|financial crime|transaction services|due diligence|restructuring|deals?)\b"
EARLY_CAREER = r"(?i)\b(?:graduate|trainee|intern(?:ship)?|apprentice|analyst|associate|officer|executive|coordinator|specialist|consultant|advisor|researcher)\b"
GENERIC_TITLE = r"(?i)^(?:graduate|trainee|intern|apprentice|analyst|associate|officer|executive|coordinator|specialist|consultant|advisor|researcher)(?:\s+[ivx0-9]+)?$"
EDUCATION = r"(?i)\b(?:mba|pgdm|chartered accountant|ca|cfa|commerce|economics|finance|accounting)\b"
CANDIDATE_OTHER_FIELD = r"(?i)\b(?:software engineering|software development|software (?:engineer|developer)|java developer|python developer|data engineer|engineering|information technology|technology|cybersecurity|systems? analyst|human resources|people operations|talent acquisition|marketing|communications|graphic design|product design|designer|design|creative|brand|visual|facilities|workplace services|customer service|customer support|customer success|sales|business development|product management|product manager|product owner|account manager|administrative)\b"
CANDIDATE_SENIOR = r"(?i)\b(?:vice president|vp|avp|svp|assistant vice president|senior vice president|managing director|executive director|director|associate director|head of|chief [a-z]+ officer|partner|principal)\b"
SENIOR_WORDING = r"(?i)\b(?:vice president|vp|avp|svp|assistant vice president|senior vice president|managing director|executive director|director|associate director|head of|chief [a-z]+ officer|partner|principal|senior manager)\b"
ENTRY_WORDING = r"\b(?:freshers?|recent graduates?|new graduates?|campus hires?|early career|entry[- ]level|no\s+(?:(?:prior|previous|any|prior work)\s+)?experience\s+(?:is\s+)?(?:required|needed|necessary|expected)|zero years?(?: of experience)?|0 years?(?: of experience)?)\b"
MID_WORDING = r"\b(?:mid[- ]level|seasoned(?: professional)?|highly experienced|extensive experience|substantial experience)\b"
TRACKING_PARAMETER = r"(?i)^(?:utm_|source$|src$|ref$|trk$)"
#: Run statuses from best to worst.
HEALTH = ("complete", "partial", "unsupported", "anomalous", "failed")
