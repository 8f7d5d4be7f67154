"""Names, codes and rules that the oracles test against, written out apart from the code under test."""

from __future__ import annotations

from typing import NamedTuple


class Family(NamedTuple):
    codes: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()


class Item(NamedTuple):
    """One mechanism family of a card: its count column and, optionally, its funding column."""

    family: Family
    count: str
    funding: str | None = None


def item(count: str, funding: str | None, codes: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> Item:
    return Item(Family(codes, prefixes), count, funding)


# Mechanism families of the cards.
UNIT = (
    item("rpg_standard_count", "rpg_standard_funding_b", ("R01", "R03", "R15", "R21", "R33", "R34", "R37", "R56")),
    item("high_risk_count", "high_risk_funding_b", ("R35", "DP1", "DP2", "DP5", "RF1", "RM1")),
    item("centers_p_count", "centers_p_funding_b", prefixes=("P",)),
    item("p01_program_projects", None, ("P01",)),
    item("p30_center_core", None, ("P30",)),
    item("p50_specialized_centers", None, ("P50",)),
    item("coop_agreements_u_count", "coop_agreements_u_funding_b", prefixes=("U",)),
    item("u01_research_coop", None, ("U01",)),
    item("ul1_ctsa", None, ("UL1",)),
    item("u54_specialized_centers", None, ("U54",)),
    item("u19_research_programs", None, ("U19",)),
    item("training_t_count", "training_t_funding_b", prefixes=("T",)),
    item("t32_institutional_training", None, ("T32",)),
    item("t35_short_term_training", None, ("T35",)),
    item("career_dev_count", "career_dev_funding_b", ("R00",), prefixes=("K",)),
    item("k99_pathway_independence", None, ("K99",)),
    item("k01_mentored_scientist", None, ("K01",)),
    item("k08_clinical_scientist", None, ("K08",)),
    item("k23_patient_oriented", None, ("K23",)),
    item("fellowship_count", "fellowship_funding_b", prefixes=("F",)),
    item("f31_predoctoral", None, ("F31",)),
    item("f32_postdoctoral", None, ("F32",)),
    item("f30_md_phd", None, ("F30",)),
    item("sbir_sttr_count", "sbir_sttr_funding_b", ("R41", "R42", "R43", "R44", "U43", "U44")),
    item("infrastructure_count", "infrastructure_funding_b", prefixes=("C", "G", "S")),
    item("g12_rcmi_minority", None, ("G12",)),
    item("s06_mbrs_minority", None, ("S06",)),
    item("c06_construction", None, ("C06",)),
)
UNIT_ALL_MECHANISMS = (
    item("rpg_count", "rpg_funding_b", ("R01", "R03", "R15", "R21", "R33", "R34", "R37", "R56")),
    item("high_risk_count", "high_risk_funding_b", ("R35", "DP1", "DP2", "DP5", "RF1", "RM1")),
    item("centers_count", "centers_funding_b", prefixes=("P",)),
    item("p01_count", None, ("P01",)),
    item("p30_count", None, ("P30",)),
    item("p50_count", None, ("P50",)),
    item("coop_agreements_count", "coop_agreements_funding_b", prefixes=("U",)),
    item("u01_count", None, ("U01",)),
    item("ul1_ctsa_count", None, ("UL1",)),
    item("u54_count", None, ("U54",)),
    item("training_count", "training_funding_b", prefixes=("T",)),
    item("t32_count", None, ("T32",)),
    item("career_count", "career_funding_b", ("R00",), prefixes=("K",)),
    item("fellowship_count", "fellowship_funding_b", prefixes=("F",)),
    item("sbir_count", "sbir_funding_b", ("R41", "R42", "R43", "R44", "U43", "U44")),
    item("infrastructure_count", "infrastructure_funding_b", prefixes=("C", "G", "S")),
    item("g12_rcmi_count", None, ("G12",)),
    item("s06_mbrs_count", None, ("S06",)),
    item("contract_count", "contract_funding_b", prefixes=("N",)),
    item("n01_research_contracts", None, ("N01",)),
    item("intramural_count", "intramural_funding_b", prefixes=("Z",)),
    item("z01_intramural_research", None, ("Z01",)),
    item("zia_intramural_research", None, ("ZIA",)),
)
UNIT_COMPLETE = (
    item("rpg_total_awards", "rpg_total_funding_b", ("R01", "R03", "R15", "R21", "R34", "R35", "R37", "R56", "RF1", "RM1", "DP1", "DP2", "DP5")),
    item("center_total_awards", "center_total_funding_b", prefixes=("P",)),
    item("fellowship_total_awards", "fellowship_total_funding_b", ("F30", "F31", "F32", "F33", "K01", "K02", "K07", "K08", "K22", "K23", "K24", "K25", "K99", "R00")),  # noqa: E501
    item("training_total_awards", "training_total_funding_b", ("T32", "T34", "T35", "T36", "T37", "T90", "TL1", "TU2")),
    item("sbir_total_awards", "sbir_total_funding_b", ("R41", "R42", "R43", "R44", "U43", "U44")),
)
UNIT_TREND = (
    item("rpg_awards", "rpg_funding_m", ("R01", "R03", "R15", "R21", "R34", "R35", "R37", "R56", "RF1", "RM1", "DP1", "DP2", "DP5")),
    item("center_awards", "center_funding_m", prefixes=("P",)),
    item("fellowship_awards", "fellowship_funding_m", ("F30", "F31", "F32", "F33", "K01", "K02", "K07", "K08", "K22", "K23", "K24", "K25", "K99", "R00")),
    item("training_awards", "training_funding_m", ("T32", "T34", "T35", "T36", "T37", "T90", "TL1", "TU2")),
    item("sbir_awards", "sbir_funding_m", ("R41", "R42", "R43", "R44", "U43", "U44")),
)
PERSON_PORTFOLIO = (
    item("rpg_awards", "rpg_funding_m", ("R01", "R03", "R15", "R21", "R34", "R35", "R37", "R56", "RF1", "RM1", "DP1", "DP2", "DP5")),
    item("center_awards", "center_funding_m", prefixes=("P",)),
    item("fellowship_awards", "fellowship_funding_m", ("F30", "F31", "F32", "F33", "K01", "K02", "K07", "K08", "K22", "K23", "K24", "K25", "K99", "R00")),
    item("training_awards", "training_funding_m", ("T32", "T34", "T35", "T36", "T37", "T90", "TL1", "TU2")),
    item("sbir_awards", "sbir_funding_m", ("R41", "R42", "R43", "R44", "U43", "U44")),
)
PERSON = (
    item("rpg_awards", "rpg_funding_m", ("R01", "R03", "R15", "R21", "R33", "R34", "R37", "R56")),
    item("high_risk_awards", "high_risk_funding_m", ("R35", "DP1", "DP2", "DP5", "RF1")),
    item("center_awards", "center_funding_m", prefixes=("P",)),
    item("coop_agreement_awards", "coop_agreement_funding_m", prefixes=("U",)),
    item("training_awards", None, prefixes=("T",)),
    item("career_awards", None, ("R00",), prefixes=("K",)),
    item("k99_awards", None, ("K99",)),
    item("fellowship_awards", None, prefixes=("F",)),
    item("sbir_awards", None, ("R41", "R42", "R43", "R44")),
    item("infrastructure_awards", None, prefixes=("C", "G", "S")),
)
PERSON_ALL_MECHANISMS = (
    item("rpg_awards", "rpg_funding_m", ("R01", "R03", "R15", "R21", "R33", "R34", "R37", "R56")),
    item("high_risk_awards", None, ("R35", "DP1", "DP2", "DP5", "RF1")),
    item("center_awards", None, prefixes=("P",)),
    item("coop_agreement_awards", None, prefixes=("U",)),
    item("training_awards", None, prefixes=("T",)),
    item("career_awards", None, ("R00",), prefixes=("K",)),
    item("fellowship_awards", None, prefixes=("F",)),
    item("sbir_awards", None, ("R41", "R42", "R43", "R44")),
    item("infrastructure_awards", None, prefixes=("C", "G", "S")),
    item("contract_awards", None, prefixes=("N",)),
    item("intramural_awards", None, prefixes=("Z",)),
)
ORGANIZATION_SPECIAL = (
    item("area_total_awards", "area_total_funding_m", ("R15",)),
    item("minority_serving_awards", "minority_serving_funding_m", ("G12", "U54", "S06")),
    item("ctsa_awards", "ctsa_funding_m", ("UL1",)),
    item("specialized_center_awards", "specialized_center_funding_m", ("P50", "P30", "P60")),
    item("infrastructure_awards", "infrastructure_funding_m", ("C06", "G20")),
)
ORGANIZATION_COMPLETE = (
    item("rpg_total", "rpg_funding_b", ("R01", "R03", "R15", "R21", "R34", "R35", "R37", "R56", "RF1", "RM1", "DP1", "DP2", "DP5")),
    item("center_total", "center_funding_b", prefixes=("P",)),
    item("fellowship_total", "fellowship_funding_b", ("F30", "F31", "F32", "F33", "K01", "K02", "K07", "K08", "K22", "K23", "K24", "K25", "K99", "R00")),
    item("training_total", "training_funding_b", ("T32", "T34", "T35", "T36", "T37", "T90", "TL1", "TU2")),
    item("sbir_total", "sbir_funding_b", ("R41", "R42", "R43", "R44", "U43", "U44")),
)
ORGANIZATION = (
    item("rpg_total", "rpg_funding_b", ("R01", "R03", "R15", "R21", "R33", "R34", "R37", "R56")),
    item("high_risk_total", None, ("R35", "DP1", "DP2", "DP5", "RF1")),
    item("center_total", "center_funding_b", prefixes=("P",)),
    item("p30_core_grants", None, ("P30",)),
    item("p50_specialized_centers", None, ("P50",)),
    item("coop_agreement_total", "coop_agreement_funding_b", prefixes=("U",)),
    item("ul1_ctsa_awards", None, ("UL1",)),
    item("u54_awards", None, ("U54",)),
    item("training_total", None, prefixes=("T",)),
    item("t32_awards", None, ("T32",)),
    item("career_total", None, ("R00",), prefixes=("K",)),
    item("fellowship_total", None, prefixes=("F",)),
    item("sbir_total", None, ("R41", "R42", "R43", "R44")),
    item("infrastructure_total", None, prefixes=("C", "G", "S")),
    item("g12_rcmi_awards", None, ("G12",)),
    item("s06_mbrs_awards", None, ("S06",)),
    item("c06_construction_awards", None, ("C06",)),
)
ORGANIZATION_ALL_MECHANISMS = (
    item("rpg_total", "rpg_funding_b", ("R01", "R03", "R15", "R21", "R33", "R34", "R37", "R56")),
    item("high_risk_total", None, ("R35", "DP1", "DP2", "DP5", "RF1")),
    item("center_total", "center_funding_b", prefixes=("P",)),
    item("p30_core_grants", None, ("P30",)),
    item("p50_specialized_centers", None, ("P50",)),
    item("coop_agreement_total", "coop_agreement_funding_b", prefixes=("U",)),
    item("ul1_ctsa_awards", None, ("UL1",)),
    item("u54_awards", None, ("U54",)),
    item("training_total", None, prefixes=("T",)),
    item("t32_awards", None, ("T32",)),
    item("career_total", None, ("R00",), prefixes=("K",)),
    item("fellowship_total", None, prefixes=("F",)),
    item("sbir_total", None, ("R41", "R42", "R43", "R44")),
    item("infrastructure_total", None, prefixes=("C", "G", "S")),
    item("g12_rcmi_awards", None, ("G12",)),
    item("s06_mbrs_awards", None, ("S06",)),
    item("c06_construction_awards", None, ("C06",)),
    item("contract_total", None, prefixes=("N",)),
    item("intramural_total", None, prefixes=("Z",)),
)
ORGANIZATION_YEARLY = (
    item("rpg_awards", "rpg_funding_m", ("R01", "R03", "R15", "R21", "R34", "R35", "R37", "R56", "RF1", "RM1", "DP1", "DP2", "DP5")),
    item("center_awards", "center_funding_m", prefixes=("P",)),
    item("fellowship_awards", "fellowship_funding_m", ("F30", "F31", "F32", "F33", "K01", "K02", "K07", "K08", "K22", "K23", "K24", "K25", "K99", "R00")),
    item("training_awards", "training_funding_m", ("T32", "T34", "T35", "T36", "T37", "T90", "TL1", "TU2")),
    item("sbir_awards", "sbir_funding_m", ("R41", "R42", "R43", "R44", "U43", "U44")),
    item("area_awards", "area_funding_m", ("R15",)),
    item("minority_serving_awards", "minority_serving_funding_m", ("G12", "U54", "S06")),
    item("ctsa_awards", "ctsa_funding_m", ("UL1",)),
)
PORTFOLIO_YEAR = (
    item("rpg_awards", "rpg_funding_b", ("R01", "R03", "R15", "R21", "R33", "R34", "R37", "R56")),
    item("center_awards", "center_funding_b", prefixes=("P",)),
    item("coop_agreement_awards", "coop_agreement_funding_b", prefixes=("U",)),
    item("training_awards", "training_funding_b", prefixes=("T",)),
    item("career_awards", None, ("R00",), prefixes=("K",)),
    item("fellowship_awards", None, prefixes=("F",)),
)
ELIGIBLE = Family(("R01", "R21", "R03", "R15", "R35", "U01", "U19", "P01", "P30", "P50", "DP1", "DP2", "DP5"), ())
# Codes and names given to the star tables.
ACTIVITY_CODES = (
    "R01", "R01", "R01", "R21", "R03", "R15", "R33", "R34", "R35", "R37", "R56", "RF1", "RM1", "DP1", "DP2", "DP5",
    "P01", "P30", "P50", "P60", "U01", "U19", "U54", "U43", "U44", "UL1", "T32", "T34", "T35", "TL1", "K01", "K08",
    "K23", "K99", "R00", "F30", "F31", "F32", "R41", "R42", "R43", "R44", "G12", "G20", "S06", "C06", "N01", "Z01",
    "ZIA", "R25",
)
UNIT_CODES = (
    "AG", "AI", "CA", "DK", "GM", "HD", "HL", "MH", "NS", "EB", "ES", "EY", "DA", "RR", "OD", "RM", "FD", "CD", "HS",
    "VA", "DOD", "TR", "TW", "XX", "YY",
)
DOMAINS = (
    "ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD",
)
CATEGORIES = (
    "Cancer", "Neurosciences", "Mental Health", "Infectious Diseases", "Vaccine Related", "Genetics",
    "Biotechnology", "Rare Diseases", "Behavioral and Social Science", "Bioengineering",
    "Clinical Trials and Supportive Activities", "Prevention", "Molecular Imaging", "Cell Biology", "Aging",
    "Nutrition",
)
SPELLED_OUT_UNITS = (
    "AI", "CA", "HL", "GM", "HD", "DK", "NS", "AG", "MH", "DA", "ES", "EY", "EB", "RR",
)
# The funding units (code, name, agency, type, department, order).
UNITS = (
    ("AA", "National Institute on Alcohol Abuse and Alcoholism", "NIH", "Research IC", "HHS", 1),
    ("AG", "National Institute on Aging", "NIH", "Research IC", "HHS", 2),
    ("AI", "National Institute of Allergy and Infectious Diseases", "NIH", "Research IC", "HHS", 3),
    ("AR", "National Institute of Arthritis and Musculoskeletal and Skin Diseases", "NIH", "Research IC", "HHS", 4),
    ("AT", "National Center for Advancing Translational Sciences", "NIH", "Research IC", "HHS", 5),
    ("CA", "National Cancer Institute", "NIH", "Research IC", "HHS", 6),
    ("DA", "National Institute on Drug Abuse", "NIH", "Research IC", "HHS", 7),
    ("DC", "National Institute on Deafness and Other Communication Disorders", "NIH", "Research IC", "HHS", 8),
    ("DE", "National Institute of Dental and Craniofacial Research", "NIH", "Research IC", "HHS", 9),
    ("DK", "National Institute of Diabetes and Digestive and Kidney Diseases", "NIH", "Research IC", "HHS", 10),
    ("EB", "National Institute of Biomedical Imaging and Bioengineering", "NIH", "Research IC", "HHS", 11),
    ("ES", "National Institute of Environmental Health Sciences", "NIH", "Research IC", "HHS", 12),
    ("EY", "National Eye Institute", "NIH", "Research IC", "HHS", 13),
    ("GM", "National Institute of General Medical Sciences", "NIH", "Research IC", "HHS", 14),
    ("HD", "Eunice Kennedy Shriver National Institute of Child Health and Human Development", "NIH", "Research IC", "HHS", 15),  # noqa: E501
    ("HG", "National Human Genome Research Institute", "NIH", "Research IC", "HHS", 16),
    ("HL", "National Heart, Lung, and Blood Institute", "NIH", "Research IC", "HHS", 17),
    ("LM", "National Library of Medicine", "NIH", "Research IC", "HHS", 18),
    ("MD", "National Institute on Minority Health and Health Disparities", "NIH", "Research IC", "HHS", 19),
    ("MH", "National Institute of Mental Health", "NIH", "Research IC", "HHS", 20),
    ("NR", "National Institute of Nursing Research", "NIH", "Research IC", "HHS", 21),
    ("NS", "National Institute of Neurological Disorders and Stroke", "NIH", "Research IC", "HHS", 22),
    ("CC", "NIH Clinical Center", "NIH", "Support IC", "HHS", 23),
    ("CIT", "Center for Information Technology", "NIH", "Support IC", "HHS", 24),
    ("CSR", "Center for Scientific Review", "NIH", "Support IC", "HHS", 25),
    ("FIC", "Fogarty International Center", "NIH", "Support IC", "HHS", 26),
    ("OD", "Office of the Director", "NIH", "Support IC", "HHS", 27),
    ("RR", "National Center for Research Resources (Legacy)", "NIH", "Support IC", "HHS", 28),
    ("RM", "NIH Common Fund", "NIH", "Common Fund", "HHS", 29),
    ("FDA", "Food and Drug Administration", "FDA", "Regulatory", "HHS", 30),
    ("FD", "FDA Orphan Products", "FDA", "Regulatory", "HHS", 31),
    ("CD", "Centers for Disease Control and Prevention", "CDC", "Public Health", "HHS", 32),
    ("HS", "Agency for Healthcare Research and Quality", "AHRQ", "Health Services", "HHS", 33),
    ("HR", "Health Resources and Services Administration", "HRSA", "Health Services", "HHS", 34),
    ("VA", "Department of Veterans Affairs", "VA", "Veterans Health", "VA", 35),
    ("DOD", "Department of Defense", "DOD", "Defense", "DOD", 36),
    ("DOE", "Department of Energy", "DOE", "Energy", "DOE", 37),
    ("NASA", "National Aeronautics and Space Administration", "NASA", "Space", "NASA", 38),
    ("OH", "Other HHS Agencies", "HHS", "Other", "HHS", 39),
    ("TR", "Trans-NIH", "NIH", "Trans-NIH", "HHS", 40),
    ("CK", "Common Fund Keck", "NIH", "Common Fund", "HHS", 41),
    ("TW", "Fogarty International (Legacy)", "NIH", "Support IC", "HHS", 42),
    ("TS", "Trans-NIH Special", "NIH", "Trans-NIH", "HHS", 43),
    ("DD", "NIH Data Discovery", "NIH", "Support IC", "HHS", 44),
    ("CE", "Common Fund Exceptional Research", "NIH", "Common Fund", "HHS", 45),
)
# Words and rules of terms and labels.
STOP_TERMS = (
    "project", "research", "study", "grant", "core", "program", "center", "development", "training", "support",
    "service", "year", "years", "aim", "specific", "aims", "proposed", "proposal", "application", "data", "analysis",
    "method", "approach", "technique", "tool", "system", "model", "process", "investigation", "evaluation", "health",
    "disease", "patient", "clinical", "treatment", "therapy", "human", "tissue", "cell", "protein", "gene",
    "molecular",
)
STOP_LEMMAS = (
    "project", "research", "study", "grant", "core", "program", "center", "development", "training", "support",
    "service", "year", "years", "aim", "specific", "aims", "proposed", "proposal", "application", "data",
    "analysis", "method", "approach", "technique", "tool", "system", "model", "process", "investigation",
    "evaluation", "health", "disease", "patient", "clinical", "treatment", "therapy", "human", "tissue", "cell",
    "cells", "protein", "proteins", "gene", "genes", "molecular", "biology", "structure", "function", "medicine",
    "new", "novel", "important", "major", "basic", "translational",
)
GENERIC_TERMS = (
    "cell", "cells", "protein", "proteins", "gene", "genes", "expression", "function", "regulation", "activity",
    "level", "development", "role", "mechanism", "process", "system", "study", "studies", "research", "analysis",
    "method", "data", "model", "disease", "human", "patient", "clinical", "work", "testing", "base", "goals", "test",
)
GENERIC_DOMAIN_TERMS = (
    "cell", "cells", "protein", "proteins", "gene", "genes", "expression", "function", "regulation", "activity",
    "level", "development", "role", "mechanism", "process", "system", "study", "studies", "research", "analysis",
    "method", "data", "model", "disease", "human", "patient", "clinical", "work", "testing", "base", "goals", "test",
    "measure",
)
IRREGULAR = {
    "mice": "mouse",
    "children": "child",
    "men": "man",
    "women": "woman",
    "feet": "foot",
    "teeth": "tooth",
    "bacteria": "bacterium",
    "criteria": "criterion",
    "phenomena": "phenomenon",
    "analyses": "analysis",
    "hypotheses": "hypothesis",
    "matrices": "matrix",
    "vertebrae": "vertebra",
    "nuclei": "nucleus",
    "fungi": "fungus",
}
DOMAIN_KEYWORDS = (
    ("In Vivo & Translational", "xenograft|wound|obesity|in vivo"),
    ("Molecular & Cell Biology", "laboratory mouse|gene expression|protein structure"),
    ("Research Infrastructure", "program|faculty|university|training"),
    ("Biomedical Imaging", "imaging|tomography|x-ray"),
    ("Clinical & Behavioral", "intervention|adolescent|behavioral"),
)
DOMAIN_KEYWORDS_LONG = (
    ("In Vivo and Translational", "xenograft|in vivo|wound|obesity"),
    ("Molecular and Cell Biology", "laboratory mouse|gene expression|protein structure"),
    ("Research Infrastructure and Training", "program|faculty|university|training"),
    ("Biomedical Imaging and Analysis", "imaging|tomography|x-ray"),
    ("Epidemiology and Global Health", "world health|global|epidemiology"),
)
DOMAIN_RULES = (
    (9, "cancer|neoplasm|oncology"),
    (5, "brain|neuro|mental|alzheimer|parkinson"),
    (7, "infectious|hiv|aids|vaccine|immunology"),
    (3, "genetic|genome|biotechnology"),
    (4, "rare disease"),
    (2, "behavioral|social"),
    (10, "bioengineering|device|technology"),
    (1, "clinical trial|prevention"),
    (6, "molecular|cell biology"),
)
OTHER_CATEGORY = "Cellular Mechanisms"
OTHER_CATEGORY_LONG = "Cellular and Molecular Mechanisms"
DOMAIN_NAMES = (
    "Clinical Trials & Prevention", "Behavioral & Social Science", "Genetics & Biotechnology",
    "Rare Diseases & Genomics", "Neuroscience & Behavior", "Molecular Biology & Genomics",
    "Infectious Disease & Immunology", "Clinical & Translational Research", "Cancer Biology & Oncology",
    "Bioengineering & Technology",
)
