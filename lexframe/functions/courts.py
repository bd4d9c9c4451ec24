"""Court tokens and report series, as the tables that citations are held against."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Court tokens of medium-neutral citations.
COURTS = (
    "HCA", "HCASL", "HCASJ", "FCA", "FCAFC", "FamCA", "FamCAFC", "FCCA", "FMCA", "FMCAfam", "FedCFamC1F", "FedCFamC1A", "FedCFamC2F", "FedCFamC2G", "FCFCOA",
    "ARTA", "AATA", "FWC", "FWCFB", "FWA", "FWAFB", "AIRC", "AIRCFB", "ACompT", "ACopyT", "AICmr", "AICmrCN", "ATP", "NNTTA", "ADFDAT",
    "NSWSC", "NSWCA", "NSWCCA", "NSWLEC", "NSWDC", "NSWLC", "NSWIRComm", "NSWCAT", "NSWCATAD", "NSWCATAP", "NSWCATCD", "NSWCATGD", "NSWCATOD", "NSWADT", "NSWADTAP",
    "VSC", "VSCA", "VCC", "VMC", "VCAT", "QSC", "QCA", "QDC", "QMC", "QCAT", "QCATA", "SASC", "SASCFC", "SASCA", "SADC", "SAERDC", "SACAT",
    "WASC", "WASCA", "WADC", "WASAT", "TASSC", "TASCCA", "TASFC", "TASCAT", "ACTSC", "ACTCA", "ACTMC", "ACAT", "NTSC", "NTCA", "NTCCA", "NTMC", "NTCAT",
)
#: Report series whose year stands in round brackets, and those whose year is the volume, in square ones.
ROUND_SERIES = (
    "CLR", "FCR", "NSWLR", "SASR", "WAR", "Tas R", "ACTR", "NTR", "Fam LR", "ALR", "ALJR", "FLR", "ACTLR",
    "A Crim R", "ACSR", "ACLC", "IR", "AILR", "IPR", "ATD", "ATR", "ATC", "LGERA", "VLR",
)
SQUARE_SERIES = ("VR", "Qd R", "NSWR")
#: Series by rank, authorised ones (1) and general ones (2); all others report one subject (3).
AUTHORISED = ("CLR", "FCR", "NSWLR", "VR", "Qd R", "SASR", "WAR", "Tas R", "ACTR", "NTR", "Fam LR")
GENERAL = ("ALR", "ALJR", "FLR", "ACTLR", "NSWR")
#: Series that older volumes printed with the other bracket.
EITHER_BRACKET = ("WAR", "Tas R")


#: Courts that hear appeals, and full benches.
APPELLATE = (
    "FCAFC", "FamCAFC", "FedCFamC1A", "NSWCA", "NSWCCA", "VSCA", "QCA", "SASCA", "SASCFC", "WASCA", "TASCCA", "TASFC", "ACTCA", "NTCA", "NTCCA",
    "FWCFB", "FWAFB", "AIRCFB", "NSWADTAP", "NSWCATAP", "QCATA",
)
APEX = ("HCA", "HCASL", "HCASJ")


def token_key(token: Column) -> Column:
    """A court token or series name as it is looked up: no dots, no white space, upper case."""
    return F.upper(F.regexp_replace(token, r"[.\s]", ""))


def _keys(names: tuple[str, ...]) -> list[str]:
    return [n.replace(" ", "").upper() for n in names]


def is_court(token: Column) -> Column:
    return token_key(token).isin(*_keys(COURTS))


def is_series(token: Column) -> Column:
    return token_key(token).isin(*_keys(ROUND_SERIES + SQUARE_SERIES))


def wrong_bracket(token: Column, bracket: Column) -> Column:
    """Whether a known series is written with the other kind of bracket than its own."""
    key = token_key(token)
    free = key.isin(*_keys(EITHER_BRACKET))
    round_one, square_one = key.isin(*_keys(ROUND_SERIES)) & (bracket != "round"), key.isin(*_keys(SQUARE_SERIES)) & (bracket != "square")
    return ~free & (round_one | square_one)


def series_rows() -> list[tuple[str, str, str, int]]:
    """(key, series, bracket, rank) of the known report series; bracket is round, square or either."""
    kind = {n: "round" for n in ROUND_SERIES} | {n: "square" for n in SQUARE_SERIES} | {n: "either" for n in EITHER_BRACKET}
    return [(_keys((n,))[0], n, b, 1 if n in AUTHORISED else 2 if n in GENERAL else 3) for n, b in kind.items()]


#: Where a court sits, by how its token begins or by the token; all others are federal.
SEATS = (
    ("act", ("ACTSC", "ACTCA", "ACTMC", "ACAT")), ("nt", ("NTSC", "NTCA", "NTCCA", "NTMC", "NTCAT")), ("vic", ("VSC", "VSCA", "VCC", "VMC", "VCAT")),
    ("nsw", tuple(c for c in COURTS if c.startswith("NSW"))), ("qld", tuple(c for c in COURTS if c.startswith("Q"))), ("sa", tuple(c for c in COURTS if c.startswith("SA"))),
    ("wa", tuple(c for c in COURTS if c.startswith("WA"))), ("tas", tuple(c for c in COURTS if c.startswith("TAS"))),
)


def court_code(token: Column) -> Column:
    """A known court's token as it is written, null for another."""
    key = token_key(token)
    written = F.create_map(*(F.lit(x) for c in COURTS for x in (c.upper(), c)))
    return F.when(key.isin(*_keys(COURTS)), F.try_element_at(written, key))


def court_seat(code: Column) -> Column:
    """The jurisdiction of a known court: cth, nsw, vic, qld, sa, wa, tas, act or nt; null for null."""
    seat = F.lit("cth")
    for name, codes in SEATS:
        seat = F.when(code.isin(*codes), name).otherwise(seat)
    return F.when(code.isNotNull(), seat)


def court_tier(token: Column) -> Column:
    """0 for the High Court, 1 for courts of appeal and full benches, 2 for all else."""
    key = token_key(token)
    return F.when(key.isin(*_keys(APEX)), 0).when(key.isin(*_keys(APPELLATE)), 1).otherwise(2)
