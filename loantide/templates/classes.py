"""The asset classes: field rules, silver types, keys and topic ranges."""

from __future__ import annotations

from dataclasses import dataclass, field

from loantide.templates.rules import Rule, amortisation_rules, expand, parse_rules


@dataclass(frozen=True)
class Template:
    """``topics`` maps a topic to its field-number range; ``general`` fields lead every topic."""

    name: str
    prefix: str
    first_column: str
    first_label: str
    keys: tuple[str, ...]
    rules: dict[str, Rule]
    types: dict[str, str]
    general: tuple[int, int] = (1, 1)
    topics: dict[str, tuple[int, int]] = field(default_factory=dict)
    loan_key: str | None = None
    max_columns: int | None = None


_TYPE_OF = {"number": "double", "integer": "int", "datetime": "date", "string": "string"}


def types_of(rules: dict[str, Rule], **overrides: str) -> dict[str, str]:
    """Silver types that follow from the rules; Y/N fields become booleans."""
    types = {
        f: "boolean" if r.allowed == ("Y", "N") else _TYPE_OF[r.type] for f, r in rules.items()
    }
    return {**types, **overrides}


def _typed(prefix: str, **by_type: str) -> dict[str, str]:
    return {f"{prefix}{n}": t for t, spec in by_type.items() for n in expand(spec)}


# The field rules of each class.
SME_ASSETS = """
anydate 2012-01-01..2030-12-31!: 1
text!: 2-7 15 16 52
text: 8 17 24 31-36 42 43 45 92 111
code5: 18 26 68
anydate ..2030-12-31: 19
code4: 22 123
code8: 25
code13: 57
code6: 58 59 94 129
code7!: 62
code3: 65
code10!: 83
code12!: 84
flag: 23 29 121 122 131
flag!: 53
num!: 37 54-56 66 85 115-118 125 132
num: 27 28 30 38-41 44 60 61 63 64 69 80-82 86 88 90 93 100-110 119 120 126 128 135 136 138
date!: 51
date: 20 50 67 70 71 87 89 91 112 124 127 130 133 134 137
"""
SME_COLLATERAL = """
text!: 1 2 24
text: 16 17 20 25-27
code5: 3
code23: 6
code9: 13
code3: 14
code4: 23
flag: 7-9
num!: 10 28
num: 4 5 15 18 19 21
date: 11 12 22
"""
SME_BONDS = """
date!: 1
text!: 2 19 20
text: 6
flag!: 5 12
num!: 13
num: 3 4 11 30 31 33-37
"""
CONSUMER_ASSETS = """
anydate 2012-01-01..2030-12-31!: 1
text!: 2 3 5 8 10
text: 4 6 15 18 20
flag: 7 43 61
num!: 26
num: 11 17 23 25 27 31 32 34-37 42 44 45 49 50 52 55 59
date: 12 21 24 41 60
anydate: 22
anydate 2012-01-01: 51 56
codes 0-9: 16
codes 0-6: 19
codes 0-10: 58
code8: 28 39
code5: 29
code13: 30 33
code3: 38
code6: 40
"""
CONSUMER_BONDS = """
date!: 1 39
anydate 2012-01-01!: 38
text!: 2 19 20 25 29
text: 26
flag: 4 5 12
num: 11 13-17 30 31 33 35-37 43-46
anynum: 34
date: 18 27 28 42
anydate: 40
codes 0-18: 32
codes 0-5: 41
"""
MORTGAGE_ASSETS = """
date!: 1
text!: 2 3 5 6
text: 7 8 17 25 46 65 75 78 128 129 134 140 147 153
flag: 4 16 22 23 36 41 47 64 68 91 96 122 158 159 174 183
num!: 67 109
num: 19 24 26 28 31-34 40 42 48 49 61-63 66 71 73 76 77 79-83 85 87 88 90 92-95 97 99-101 111-113 115 117 120 135 136 139 141-143 146 148-150 154-157 160 170-172 176 177 179 181 182
anynum: 110 169 180
date: 18 20 35 38 45 55 57 86 89 98 116 118 121 138 145 151 167 168 173 175 178
anydate: 56 114 133
code3: 15 30 132
code4: 84
code5: 27 29 130 152
code6: 39 58 60 70 166
code7: 37 43
code8: 44 107
code9: 21 69 137 144
code10: 74
code11: 131
code13: 72 108 119
code17: 59
"""
MORTGAGE_BONDS = """
date!: 1 27 28 39
text!: 2 19 20 25 26 29
flag!: 5 12
num!: 13
num: 3 4 11 30 31 33-37
anydate: 38
code9!: 32
"""
ESMA_AUTO = r"""
text28!: 1
text1000!: 2-5
anydate!: 6
anydate: 7-9 24 25 33 50 51 65-67 73
text: 10
like ^\d{4}$: 11 55
oneof EMRS EMBL EMUK UNEM SFEM NOEM STNT PNNR OTHR: 12
flag: 13
oneof PUBL LLCO PNTR INDV GOVT OTHR: 14
oneof CNEO CEMO CNRO ENEO EEMO ENRO OTHR: 15
num: 16 20 29-31 37-40 45 46 49 52 60-64 72 76-78
oneof GRAN NITS NITX NTIN ENIS EITX EISS DSPL CORP OTHR: 17
like ^[A-Z]{3}$: 18 21
oneof SCRT SCNF VRFD NVRF SCRG OTHR: 19
text10000: 22
oneof PPUR PHIR HIRP LEAP FNLS OPLS OTHR: 23
int: 26 44 47
oneof ADLR BROK DIRE IDRT OTHR: 27
like ^[A-Z]{3}$!: 28
oneof FRXX DEXX FIXE BLLT OTHR: 32
oneof MNTH QUTR SEMI YEAR OTHR: 34 35
oneof CDTX SORD CHKX CASH BTRA OTHR: 36
oneof MAAA FUSW LIBI LIBO SWAP TREA EURI PFAN EONA EONS EUUS EUCH TIBO ISDA GCFR STBO BBSW JIBA BUBO CDOR CIBO MOSP NIBO PRBO TLBO WIBO BOER ECBR LDOR OTHR: 41
oneof OVNG INDA DAIL WEEK TOWK MNTH TOMN QUTR FOMN SEMI YEAR ONDE OTHR: 42
anynum: 43 74 75
pct: 48 59
text100: 53 54 58 79
oneof NEWX USED DEMO OTHR: 56
oneof EPCA EPCB EPCC EPCD EPCE EPCF EPCG OTHR: 57
num!: 68
int!: 69
oneof PERF RNAR RARR DFLT NDFT DTCR DADB ARRE REBR REDF RERE RESS REOT RDMD OTHR!: 70
oneof UPXX PDXX UPPD: 71
like ^[0-9A-Z]{20}$: 80
like ^[A-Z]{2}$: 81
text100!: 82
like ^[0-9A-Z]{20}$!: 83
like ^[A-Z]{2}$!: 84
"""
# The auto class has silver types but no published field rules.
AUTO_TYPES = _typed(
    "AA",
    date="1 22 23 25 32 47 53 58 67 72",
    boolean="7 56",
    double="17 24 26-28 30 31 34 35 37 39 40 42 43 49-52 59-61 65 66 68-71 73",
    string="2-6 8-10 15 16 18-21 29 33 36 41 44-46 48 54 55 57 74",
)

# Types of the deal details that are no text.
DEAL_TYPES = {
    **dict.fromkeys((
        "Primary Income", "Revenue", "Original Principal Balance", "Current Principal Balance", "Purchase Price", "Payment Due", "Balloon Amount",
        "Down Payment Amount", "Current Interest Rate", "Current Interest Rate Margin", "Interest Rate Cap", "Interest Rate Floor",
        "Percentage Of Prepayments Allowed Per Year", "Prepayment Fee", "Cumulative Prepayments", "Original Loan-To-Value",
        "Original Valuation Amount", "Original Residual Value Of Vehicle", "Option To Buy Price", "Securitised Residual Value",
        "Updated Residual Value Of Vehicle", "Arrears Balance", "Default Amount", "Allocated Losses", "Residual Value Losses",
        "Cumulative Recoveries", "Sale Price", "Deposit Amount",
    ), "double"),
    **dict.fromkeys(("Original Term", "Interest Rate Reset Interval", "Number Of Payments Before Securitisation", "Number Of Days In Arrears"), "int"),
}

_sme = parse_rules("AS", SME_ASSETS)
_sme_coll = parse_rules("CS", SME_COLLATERAL)
_sme_bonds = parse_rules("BS", SME_BONDS)
_cons = parse_rules("AN", CONSUMER_ASSETS)
_cons_bonds = parse_rules("BN", CONSUMER_BONDS)
_mort = parse_rules("AR", MORTGAGE_ASSETS)
_mort_bonds = parse_rules("BR", MORTGAGE_BONDS)
_esma = parse_rules("AUTL", ESMA_AUTO)
_amort = amortisation_rules()

# Bond topics per class; the numbers are the field ranges.
_BOND = {"bond_info": (3, 18), "transaction_info": (19, 24), "tranche_info": (25, 50)}

TEMPLATES: dict[str, Template] = {
    t.name: t
    for t in [
        Template("sme_assets", "AS", "AS1", "Pool Cut-off Date", ("AS1", "AS3"), _sme,
                 types_of(_sme, AS21="string", AS31="date", AS89="string"), (1, 14),
                 {"obligor_info": (15, 49), "loan_info": (50, 79), "interest_rate": (80, 99),
                  "financial_info": (100, 114), "performance_info": (115, 145)}, "AS3"),
        Template("sme_collateral", "CS", "CS1", "Collateral ID", ("CS1",), _sme_coll, types_of(_sme_coll), (1, 28)),
        Template("sme_bonds", "BS", "BS1", "Report Date", ("BS1", "BS2"), _sme_bonds,
                 types_of(_sme_bonds, **{f"BS{i}": "string" for i in (25, 26, 29, 32)},
                          **{f"BS{i}": "date" for i in (27, 28, 38, 39)}), (1, 2),
                 {"bond_info": (3, 10), "collateral_info": (11, 18), "contact_info": (19, 24), "tranche_info": (25, 39)}),
        Template("sme_amortisation", "AS", "AS3", "Loan Identifier", ("AS3",), _amort, types_of(_amort), (3, 3),
                 {}, "AS3", 121),
        Template("auto_assets", "AA", "AA1", "Pool Cut-off Date", ("AA1", "AA2"), {}, AUTO_TYPES, (1, 4),
                 {"lease_info": (5, 78)}, "AA2"),
        Template("auto_bonds", "BAA", "BAA1", "Report Date", ("BAA1", "BAA2"), {}, {}, (1, 2),
                 {"bond_info": (3, 18), "contact_info": (19, 24), "tranche_info": (25, 50)}),
        Template("consumer_assets", "AN", "AN1", "Pool Cut-off Date", ("AN1", "AN2"), _cons, types_of(_cons), (1, 5),
                 {"loan_info": (6, 48), "performance_info": (49, 64)}, "AN5"),
        Template("consumer_bonds", "BN", "BN1", "Report Date", ("BN1", "BN2"), _cons_bonds, types_of(_cons_bonds),
                 (1, 2), _BOND),
        Template("mortgage_assets", "AR", "AR1", "Pool Cut-off Date", ("AR1", "AR2"), _mort, types_of(_mort), (1, 14),
                 {"borrower_info": (15, 54), "loan_info": (55, 106), "interest_rate": (107, 127),
                  "collateral_info": (128, 165), "performance_info": (166, 195)}, "AR3"),
        Template("mortgage_bonds", "BR", "BR1", "Report Date", ("BR1", "BR2"), _mort_bonds, types_of(_mort_bonds),
                 (1, 2), {"bond_info": (3, 10), "collateral_info": (11, 18), "transaction_info": (19, 24), "tranche_info": (25, 43)}),
        Template("esma_auto", "AUTL", "AUTL1", "Unique Identifier", ("AUTL1", "AUTL2"), _esma,
                 # flags stay text in this class
                 types_of(_esma, AUTL13="string"), (1, 5), {"lease_info": (6, 84)}, "AUTL2"),
    ]
}
