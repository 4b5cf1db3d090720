"""They must be these for right results."""

# Two-digit state codes of tax registration numbers.
STATE_CODES = {
    "01": "Jammu and Kashmir", "02": "Himachal Pradesh", "03": "Punjab", "04": "Chandigarh", "05": "Uttarakhand",
    "06": "Haryana", "07": "Delhi", "08": "Rajasthan", "09": "Uttar Pradesh", "10": "Bihar", "11": "Sikkim",
    "12": "Arunachal Pradesh", "13": "Nagaland", "14": "Manipur", "15": "Mizoram", "16": "Tripura", "17": "Meghalaya",
    "18": "Assam", "19": "West Bengal", "20": "Jharkhand", "21": "Odisha", "22": "Chhattisgarh", "23": "Madhya Pradesh",
    "24": "Gujarat", "26": "Dadra and Nagar Haveli and Daman and Diu", "27": "Maharashtra", "29": "Karnataka",
    "30": "Goa", "31": "Lakshadweep", "32": "Kerala", "33": "Tamil Nadu", "34": "Puducherry",
    "35": "Andaman and Nicobar Islands", "36": "Telangana", "37": "Andhra Pradesh", "38": "Ladakh", "97": "Other Territory",
}
STATE_ALIASES = {
    "j&k": "01", "jammu & kashmir": "01", "hp": "02", "punjab": "03", "uttaranchal": "05", "new delhi": "07",
    "delhi ncr": "07", "nct of delhi": "07", "up": "09", "u.p.": "09", "wb": "19", "w.b.": "19", "mp": "23", "m.p.": "23",
    "bombay": "27", "maharastra": "27", "mh": "27", "bangalore": "29", "karnatka": "29", "ka": "29", "tn": "33",
    "tamilnadu": "33", "madras": "33", "ap": "37", "telengana": "36", "orissa": "21", "pondicherry": "34",
    "dadra & nagar haveli": "26", "daman & diu": "26",
}
# Texts that mean "no value", and yes/no words.
NULL_TOKENS = ("", "null", "none", "n/a", "na", "-", "nil")
TRUE_WORDS = ("true", "yes", "y", "1", "applicable", "reverse charge applicable")
FALSE_WORDS = ("false", "no", "n", "0", "not applicable", "n/a", "na", "nil", "-")
# What names and addresses lose before they are compared, and what an amount loses before it is read.
LEGAL_SUFFIX = r"\b(private limited|pvt\.? ?ltd\.?|p\.? ?ltd\.?|limited|ltd\.?|llp|llc|inc\.?|co\.?|company|corporation|corp\.?|& sons|and sons|enterprises?|traders?)\b"
ADDRESS_NOISE = r"\b(plot|shop|unit|gala|door|khasra|no\.?|number|floor|flr|road|rd\.?|street|st\.?|near|opp\.?|opposite|behind|dist\.?|district|india|pin ?code|pin)\b"
CURRENCY = r"[₹₨$]|\bRs\.?|\bINR\b|\brupees?\b"
# Glyph pairs that readers confuse.
GLYPH_PAIRS = ("0O", "0D", "1I", "1l", "Il", "5S", "8B", "2Z", "6G", "7T", "9g", "VY", "UV", "cC", "rn")
REFUSAL_MARKERS = (
    "i can't help", "i cannot help", "i can't assist", "i cannot assist", "i'm unable to", "i am unable to",
    "cannot process", "can't process", "identity document", "personally identifiable",
)
FUZZY_THRESHOLD = 88
TAX_SLABS = (5, 12, 18, 28)
# Amounts among which a wrong number is sought, in order: of the header, of each line.
HEADER_AMOUNTS = ("total_taxable_value", "cgst_amount", "sgst_amount", "igst_amount", "cess_amount", "grand_total", "round_off")
LINE_AMOUNTS = ("taxable_value", "quantity", "unit_price", "tax_rate", "discount")
# Patterns by which the rules baseline reads text.
GSTIN_PATTERN = r"\b\d{2}[A-Z]{5}\d{4}[A-Z][0-9A-Z][Z][0-9A-Z]\b"
DATE_PATTERN = r"\b(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{1,2}[-\s][A-Za-z]{3,9}[-\s]\d{2,4}|\d{4}-\d{2}-\d{2})\b"
NUMBER_PATTERN = r"(?:invoice|bill|document)\s*(?:no|number|#)\s*[:.\-]?\s*([A-Z0-9][A-Z0-9/\-]{2,24})"
AMOUNT_PATTERN = r"(?:(?:₹|Rs\.?|INR)\s*)?(\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
# Resolution of the four degradation levels.
LADDER = (("L0_clean", 300), ("L1_scan", 300), ("L2_photo", 150), ("L3_harsh", 72))
