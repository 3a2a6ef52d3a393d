"""Word lists of names and addresses.  Fixed values: results depend on them."""

# Fixed values.
LEGAL = (
    "llc inc ltd limited private pvt corp corporation co company llp pc plc lp the and of pllc incorporated opc ll p l "
    "sarl sas sasu eurl sa sci snc scop scea sca gie eirl selarl selas selasu groupement "
    "gmbh ag kg ohg mbh srl sl spa bv nv oy ab as kft"
).split()
LEGAL_SKELETONS = "prvt lmtd lmt pr l prl ltd llp kmpn kp prvtl lmtdd".split()
ABBREVIATIONS = {
    "dr": "drive", "rd": "road", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "ln": "lane",
    "ct": "court", "hwy": "highway", "pkwy": "parkway", "cir": "circle", "pl": "place", "ter": "terrace", "trl": "trail",
    "sq": "square", "mt": "mount", "ft": "fort", "n": "north", "s": "south", "e": "east", "w": "west", "nr": "near",
    "opp": "opposite", "cross": "cross", "r": "rue", "bd": "boulevard", "che": "chemin", "chem": "chemin", "all": "allee",
    "imp": "impasse", "fg": "faubourg", "pas": "passage", "res": "residence",
}
ADDRESS_STOP = (
    "unit apartment apt floor fl suite ste near opposite no nd th rd st po box block building bldg room flat plot house "
    "shop hno sno the and"
).split()
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me",
    "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo",
    "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm",
    "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or",
    "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn",
    "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv",
    "wisconsin": "wi", "wyoming": "wy",
}
ORDINALS = {
    "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "sixth": "6th", "seventh": "7th",
    "eighth": "8th", "ninth": "9th", "tenth": "10th", "eleventh": "11th", "twelfth": "12th", "thirteenth": "13th",
    "fourteenth": "14th", "fifteenth": "15th", "sixteenth": "16th", "seventeenth": "17th", "eighteenth": "18th",
    "nineteenth": "19th", "twentieth": "20th", "thirtieth": "30th", "fortieth": "40th", "fiftieth": "50th",
}
#: Rewrites of a consonant skeleton, in this order.
SKELETON_REWRITES = [
    ("ph", "f"), ("kh", "k"), ("gh", "g"), ("bh", "b"), ("dh", "d"), ("th", "t"), ("jh", "j"), ("sh", "s"), ("ch", "k"),
    ("ck", "k"), ("qu", "k"), ("x", "ks"), ("c", "k"), ("q", "k"), ("w", "v"), ("z", "j"), ("g", "j"),
]
KEY_WEIGHTS = {
    "A": 3, "R": 2, "N": 3, "Q": 2, "P": 2, "T": 1, "U": 1, "S": 1, "K": 1, "V": 2, "X": 3, "B": 2, "Y": 2, "C": 3, "M": 2,
    "L": 2,
}
DOMAINS = ["com", "net", "org"]
INDIC_SCRIPTS = "DEVANAGARI BENGALI GURMUKHI GUJARATI ORIYA TAMIL TELUGU KANNADA MALAYALAM".split()
INDIC_VOWELS = {
    "A": "a", "AA": "a", "I": "i", "II": "i", "U": "u", "UU": "u", "E": "e", "EE": "e", "SHORT E": "e", "CANDRA E": "e",
    "AI": "ai", "O": "o", "OO": "o", "SHORT O": "o", "CANDRA O": "o", "AU": "au", "VOCALIC R": "ri", "VOCALIC RR": "ri",
    "VOCALIC L": "li", "SHORT A": "a", "CANDRA A": "a", "AW": "au", "OE": "o", "UE": "u", "PRISHTHAMATRA E": "e",
    "AI LENGTH MARK": "", "AU LENGTH MARK": "",
}
INDIC_CONSONANTS = {
    "CA": "ch", "CHA": "chh", "SSA": "sh", "SHA": "sh", "TTA": "t", "TTHA": "th", "DDA": "d", "DDHA": "dh", "NNA": "n",
    "NNNA": "n", "LLA": "l", "LLLA": "l", "RRA": "r", "ZHA": "l", "KSSA": "ksh", "JNYA": "gy", "NYA": "ny", "NGA": "ng",
    "VA": "v", "FA": "f", "ZA": "z", "NUKTA": "",
}
INDIC_NASALS = ["SIGN ANUSVARA", "SIGN CANDRABINDU", "SIGN BINDI", "SIGN TIPPI", "SIGN ADDAK"]
#: Raw pair features that the second stage keeps.
RAW2 = "nsort aset ajac akey_eq a_exact anum_first_eq w ncore_eq sk_r sk_set hnum_edit".split()
