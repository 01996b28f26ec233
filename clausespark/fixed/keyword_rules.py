"""Keyword rules per clause: a document is positive when any phrase occurs in its lower-cased text."""

# --- fixed values -------------------------------------------------------------------
KEYWORD_RULES = {
    "Non-Compete": ["non-compet", "noncompet", "covenant not to compete", "compete with"],
    "Indemnification": ["indemnif", "hold harmless", "indemnit"],
    "Termination For Convenience": ["terminat", "without cause", "at any time upon", "convenience"],
    "Change Of Control": [
        "change of control", "change-of-control", "acquisition", "merger", "takeover",
    ],
    "IP Ownership Assignment": [
        "intellectual property", "work made for hire", "assigns all right", "work-for-hire",
        "ip assignment",
    ],
    "Uncapped Liability": [
        "unlimited liability", "no limitation", "no cap on", "without limit",
    ],
    "Cap On Liability": [
        "cap on liability", "limitation of liability", "aggregate liability",
        "limited to the aggregate", "shall not exceed",
    ],
    "Governing Law": [
        "governing law", "governed by the laws", "choice of law", "laws of the state",
    ],
    "Exclusivity": ["exclusiv", "sole and exclusive", "exclusive right"],
    "Audit Rights": ["audit right", "right to audit", "audit and inspect", "right to examine"],
    "Warranty Duration": ["warrants for", "warranty period", "warranty term", "warranty of"],
    "Insurance": ["insurance", "insured", "maintain coverage", "liability insurance"],
    "Liquidated Damages": ["liquidated damages", "stipulated damages"],
    "Non-Disparagement": ["non-disparagement", "disparage", "not disparage", "disparaging"],
    "No-Solicit Of Employees": ["solicit", "no-solicit", "not solicit any employee"],
    "No-Solicit Of Customers": ["solicit any customer", "solicit client", "solicit business"],
    "Anti-Assignment": [
        "may not assign", "not assign", "anti-assignment", "without prior written consent",
    ],
    "License Grant": ["grants a license", "hereby grants", "license to use", "grant of license"],
    "Renewal Term": ["automatic renewal", "renew", "renewal term", "renewed for"],
    "Revenue/Profit Sharing": ["revenue share", "profit share", "revenue sharing", "net revenue"],
    "Minimum Commitment": [
        "minimum commitment", "minimum purchase", "minimum volume", "minimum revenue",
    ],
    "Joint IP Ownership": [
        "joint ownership", "jointly own", "co-own", "joint intellectual property",
    ],
    "Source Code Escrow": ["source code escrow", "escrow agent", "code escrow"],
    "ROFR/ROFO/ROFN": [
        "right of first refusal", "right of first offer", "right of first negotiation",
        "rofr", "rofo",
    ],
    "Most Favored Nation": ["most favored nation", "most-favored-nation", "mfn"],
    "Post-Termination Services": ["post-termination", "after termination", "wind-down services"],
    "Price Restrictions": ["price restriction", "price increase", "pricing control"],
    "Volume Restriction": ["volume restriction", "volume limit", "maximum volume"],
    "Non-Transferable License": ["non-transferable", "not transferable"],
    "Third Party Beneficiary": [
        "third party beneficiar", "third-party beneficiar", "no third party",
    ],
    "Covenant Not To Sue": ["covenant not to sue", "not to sue", "promise not to sue"],
    "Irrevocable Or Perpetual License": [
        "irrevocable license", "perpetual license", "irrevocable right",
    ],
    "Unlimited/All-You-Can-Eat-License": [
        "unlimited use", "unlimited license", "all-you-can-eat",
    ],
    "Affiliate License-Licensor": [
        "affiliates of licensor", "licensor affiliate", "licensor's affiliates",
    ],
    "Affiliate License-Licensee": [
        "affiliates of licensee", "licensee affiliate", "licensee's affiliates",
    ],
}
