"""Explicit schemas, so no job is spent on inferring them."""

from __future__ import annotations

STAR_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# The published source tables, columns in the published order, all nullable.
SOURCE_TABLES = {
    "projects":
        "APPLICATION_ID double, ACTIVITY string, ADMINISTERING_IC string, APPLICATION_TYPE double, ARRA_FUNDED string, "
        "AWARD_NOTICE_DATE string, BUDGET_START string, BUDGET_END string, CFDA_CODE double, CORE_PROJECT_NUM string, "
        "DIRECT_COST_AMT double, ED_INST_TYPE string, FOA_NUMBER string, FULL_PROJECT_NUM string, FUNDING_ICs string, "
        "FUNDING_MECHANISM string, FY double, IC_NAME string, INDIRECT_COST_AMT double, NIH_SPENDING_CATS string, "
        "ORG_CITY string, ORG_COUNTRY string, ORG_DEPT string, ORG_DISTRICT string, ORG_DUNS string, ORG_FIPS string, "
        "ORG_IPF_CODE string, ORG_NAME string, ORG_STATE string, ORG_ZIPCODE string, PHR string, PI_IDS string, "
        "PI_NAMEs string, PROGRAM_OFFICER_NAME string, PROJECT_START string, PROJECT_END string, PROJECT_TERMS string, "
        "PROJECT_TITLE string, SERIAL_NUMBER double, STUDY_SECTION string, STUDY_SECTION_NAME string, SUBPROJECT_ID double, "
        "SUFFIX string, SUPPORT_YEAR double, TOTAL_COST double, TOTAL_COST_SUB_PROJECT double, YEAR double",
    "abstracts": "APPLICATION_ID double, ABSTRACT_TEXT string, YEAR int",
    "linktables": "PMID double, PROJECT_NUMBER string, YEAR int",
    "patents": "PATENT_ID double, PATENT_TITLE string, PROJECT_ID string, PATENT_ORG_NAME string",
    "clinicalstudies": "Core_Project_Number string, ClinicalTrials_gov_ID string, Study string, Study_Status string",
}
