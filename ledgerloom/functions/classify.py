"""Codes read from text: property, address, person, municipal limits, place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.values import strip

# Word boundaries that also hold beside letters of Indic scripts.
_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

# Words that tell a kind of property, in the order in which kinds are tried.
PROPERTY_WORDS = {
    "I": rf"industrial|{_B}factory{_E}|{_B}KIADB{_E}|{_B}KSSIDC{_E}|godown|warehouse|manufactur|ಕೈಗಾರಿಕ|ಕಾರ್ಖಾನೆ",
    "C": rf"commercial|{_B}shop{_E}|showroom|business\s+premises|office\s+space|{_B}mall{_E}|complex\s+bearing|ವಾಣಿಜ್ಯ|ಅಂಗಡಿ",
    "R": rf"residential|dwelling|{_B}house{_E}|apartment|{_B}flat{_E}|house\s*site|ವಸತಿ|ನಿವೇಶನ|ಮನೆ",
    "N": rf"non[-\s]?agricultur|{_B}N\.?A\.?\s+(land|site|plot)|{_B}convert(ed|ion){_E}|ಪರಿವರ್ತ",
    "A": rf"agricultur|{_B}kharab{_E}|{_B}acres?{_E}|{_B}guntas?{_E}|ಕೃಷಿ|ಜಮೀನು|ಗುಂಟೆ|ಎಕರೆ",
    "Z": rf"temple|{_B}church{_E}|{_B}mosque{_E}|burial|graveyard|{_B}school{_E}|{_B}college{_E}|hospital|{_B}wakf{_E}|charitable|ದೇವಸ್ಥಾನ|ಶಾಲೆ",
}
# How a schedule begins, and how much of it is read.
NOT_AFTER = r"(?<!\bthe )(?<!\bof )(?<!\bon )(?<!\bin )(?<!\bsaid )"
SCHEDULE = r"schedule\b|ಅನುಸೂಚಿ|ಶೆಡ್ಯೂಲ್|ಪರಿಶಿಷ್ಟ"
SCHEDULE_CHARS = 2000
# Words that tell limits and kinds of address.
MUNICIPAL = rf"municipal|mahanagara|corporation|city\s+council|town\s+council|{_B}BBMP{_E}|{_B}CMC{_E}|{_B}TMC{_E}|ಮಹಾನಗರ|ನಗರಸಭೆ|ಪುರಸಭೆ"
PANCHAYAT = r"grama\s*panchayat|gram\s*panchayat|village\s+panchayat|ಗ್ರಾಮ\s*ಪಂಚಾಯ|ಪಂಚಾಯತ"
REGISTERED = rf"registered\s+office|corporate\s+office|{_B}regd\.?\s*off"
BUSINESS = rf"{_B}office{_E}|{_B}shop{_E}|godown|factory|premises|industrial|{_B}unit\s*n|business|showroom"
RESIDENTIAL = rf"{_B}residing{_E}|{_B}resident{_E}|{_B}house{_E}|{_B}flat{_E}|{_B}dwelling{_E}|{_B}village{_E}|{_B}nagar{_E}|{_B}h\.?\s?no{_E}|apartment|layout|colony"
# What the fourth letter of a PAN says about its holder.
HOLDERS = {"P": "Individual", "C": "Company", "H": "HUF", "F": "Firm", "A": "AOP", "T": "Trust", "B": "BOI", "L": "Local Authority", "J": "Artificial Juridical Person", "G": "Government"}
BUSINESS_HOLDERS = ("C", "F", "T", "A", "B", "L", "J", "G")


def _says(text: Column, words: str) -> Column:
    return F.coalesce(text.rlike(f"(?i){words}"), F.lit(False))


def schedule_section(text: Column) -> Column:
    """From the last schedule heading on, a fixed number of characters; empty without one."""
    from_last = F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?is)^.*{NOT_AFTER}((?:{SCHEDULE}).*)$", 1)
    return F.left(from_last, F.lit(SCHEDULE_CHARS))


def property_type(address: Column, text: Column) -> Column:
    """The first kind that the schedule, the address or the whole text tells, else X."""

    def kind(source: Column) -> Column:
        out = None
        for code, words in PROPERTY_WORDS.items():
            out = F.when(_says(source, words), code) if out is None else out.when(_says(source, words), code)
        return out

    return F.coalesce(kind(schedule_section(text)), kind(address), kind(text), F.lit("X"))


def municipal_limits(*texts: Column) -> Column:
    blob = F.concat_ws(" ", *texts)
    town, village = _says(blob, MUNICIPAL), _says(blob, PANCHAYAT)
    return F.when(town & ~village, "Yes").when(village & ~town, "No").otherwise("")


def _holder(pan: Column) -> Column:
    return F.substring(F.upper(strip(F.coalesce(pan, F.lit("")))), 4, 1)


def person_type(pan: Column, father: Column, gender: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in HOLDERS.items() for x in pair])
    known = (strip(F.coalesce(father, F.lit(""))) != "") | (strip(F.coalesce(gender, F.lit(""))) != "")
    return F.coalesce(F.try_element_at(kinds, _holder(pan)), F.when(known, "Individual"), F.lit(""))


def identification_type(pan: Column, aadhaar: Column) -> Column:
    given = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    return F.when(given(pan), "C").when(given(aadhaar), "G").otherwise("")


def address_type(address: Column, pan: Column) -> Column:
    text = F.coalesce(address, F.lit(""))
    work, home = _says(text, BUSINESS), _says(text, RESIDENTIAL)
    return (
        F.when(strip(text) == "", "5").when(_says(text, REGISTERED), "4").when(_holder(pan).isin(*BUSINESS_HOLDERS), "3")
        .when(work & home, "1").when(work, "3").when(home, "2").otherwise("5")
    )
