"""Data model: table schemas, the CDM registry seed, tenants and the six known layouts.

Everything below the "FIXED VALUES" marker must equal the values of the system we rebuild
(field ids, names, types, required flags, status codes, layout column names); it is data,
stated once, in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------
# Table schemas (Spark types for the relational tables of the workflow and the CDM sink)
# ---------------------------------------------------------------------------------------

CDM_SCHEMA = T.StructType([
    T.StructField("field_id", T.StringType(), False),
    T.StructField("field_name", T.StringType(), False),
    T.StructField("display_name", T.StringType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("is_required", T.BooleanType()),
    T.StructField("example_values", T.StringType()),
    T.StructField("added_by", T.StringType()),
    T.StructField("added_at", T.TimestampType()),
    T.StructField("source_customer", T.StringType()),
])

CUSTOMERS_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("customer_name", T.StringType(), False),
    T.StructField("industry", T.StringType()),
    T.StructField("contact_email", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

PROFILE_SCHEMA = T.StructType([
    T.StructField("upload_id", T.StringType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("dtype", T.StringType()),
    T.StructField("cdm_type", T.StringType()),
    T.StructField("sample_values", T.ArrayType(T.StringType())),
    T.StructField("null_count", T.LongType()),
    T.StructField("unique_count", T.LongType()),
])

# Parsed mapping document (one per proposal); kept parsed, written as JSON only at the edge.
MAPPING_ENTRY = T.StructType([
    T.StructField("source_column", T.StringType()),
    T.StructField("cdm_field", T.StringType()),
    T.StructField("transformation", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("reasoning", T.StringType()),
])
MAPPING_DOC_DDL = (
    "mappings array<struct<source_column:string,cdm_field:string,transformation:string,"
    "confidence:double,reasoning:string>>, overall_confidence double, "
    "unmapped_cdm_fields array<string>, notes string"
)

# Profile document: both stored forms read through one map type.
PROFILE_DOC_DDL = (
    "map<string,struct<dtype:string,cdm_type:string,type:string,cdm_field:string,"
    "sample_values:array<string>,null_count:bigint,unique_count:bigint>>"
)

SALES_COLUMNS = [
    "upload_id", "customer_id", "sale_date", "customer_id_val", "customer_name",
    "product_sku", "product_name", "product_category", "channel", "region",
    "units_sold", "revenue", "discount", "net_revenue", "cost", "margin",
    "store_id", "rep_id", "source_system", "ingested_at",
]

# CDM field name -> column of the conformed sales table (two are renamed, the rest keep names).
CDM_TARGET_COLUMN = {"date": "sale_date", "customer_id": "customer_id_val"}

# =======================================================================================
# FIXED VALUES — must equal the rebuilt system's values.
# =======================================================================================

# CDM seed: (field_id, field_name, display_name, data_type, description, is_required, example_values)
CDM_FIELDS = [
    ("f001", "date", "Date", "DATE", "Transaction date", True, "2024-01-15"),
    ("f002", "customer_id", "Customer ID", "STRING", "Unique customer identifier", True, "CUST_001"),
    ("f003", "customer_name", "Customer Name", "STRING", "Customer display name", False, "Acme Corp"),
    ("f004", "product_sku", "Product SKU", "STRING", "Product identifier", True, "SKU-12345"),
    ("f005", "product_name", "Product Name", "STRING", "Product display name", False, "Widget Pro"),
    ("f006", "product_category", "Product Category", "STRING", "Category/segment", False, "Electronics"),
    ("f007", "channel", "Sales Channel", "STRING", "Sales channel (POS, online, B2B)", False, "POS"),
    ("f008", "region", "Region", "STRING", "Geographic region", False, "North America"),
    ("f009", "units_sold", "Units Sold", "INTEGER", "Volume sold", True, "42"),
    ("f010", "revenue", "Revenue", "DECIMAL", "Gross revenue", True, "1250.00"),
    ("f011", "discount", "Discount", "DECIMAL", "Discount applied", False, "125.00"),
    ("f012", "net_revenue", "Net Revenue", "DECIMAL", "Revenue after discount", False, "1125.00"),
    ("f013", "cost", "Cost", "DECIMAL", "Cost of goods sold", False, "800.00"),
    ("f014", "margin", "Gross Margin", "DECIMAL", "Gross margin (revenue - cost)", False, "325.00"),
    ("f015", "store_id", "Store ID", "STRING", "Store/location identifier", False, "STORE_042"),
    ("f016", "rep_id", "Sales Rep ID", "STRING", "Sales representative identifier", False, "REP_007"),
    ("f017", "source_system", "Source System", "STRING", "Origin system (POS/CRM/ERP)", False, "POS"),
]
CDM_SEED_ADDED_BY = "system"

# Tenants: (customer_id, customer_name, industry, contact_email); only the ids are fixed.
CUSTOMERS = [
    ("CUST_001", "Tenant 1", "", ""),
    ("CUST_002", "Tenant 2", "", ""),
    ("CUST_003", "Tenant 3", "", ""),
]

UPLOAD_STATUSES = ["PENDING_MAPPING", "PENDING_REVIEW", "APPROVED", "REJECTED", "INGESTED"]
MAPPING_STATUSES = ["PENDING", "APPROVED", "REJECTED", "REVISED"]
DECISIONS = ["APPROVED", "REJECTED"]

# Status code -> label; unknown codes read as the PENDING_MAPPING label.
STATUS_LABELS = [
    ("PENDING_MAPPING", "Pending Mapping"),
    ("PENDING_REVIEW", "Pending Review"),
    ("PENDING", "Pending Review"),
    ("APPROVED", "Approved"),
    ("REJECTED", "Rejected"),
]
STATUS_LABEL_DEFAULT = "Pending Mapping"

# Confidence bands: score >= 0.9 high, >= 0.7 medium, else low.
BAND_HIGH = 0.9
BAND_MEDIUM = 0.7

# Defaults applied on write.
DEFAULT_SOURCE_SYSTEM = "UNKNOWN"
DEFAULT_REVIEWER = "analyst"
DEFAULT_UPLOAD_STATUS = "PENDING_MAPPING"
DEFAULT_MAPPING_STATUS = "PENDING"

# Column length limits (VARCHAR(n)) per table.
VARCHAR_LIMITS = {
    "customers": {"customer_id": 64, "customer_name": 256, "industry": 128, "contact_email": 256},
    "uploads": {"upload_id": 64, "customer_id": 64, "file_name": 512, "source_system": 64, "status": 32},
    "schema_mappings": {"mapping_id": 64, "upload_id": 64, "customer_id": 64, "status": 32},
    "mapping_reviews": {"review_id": 64, "mapping_id": 64, "upload_id": 64, "reviewer": 256,
                        "decision": 16},
}

# Upload file names accepted (lower-cased suffix).
ACCEPTED_SUFFIXES = [".csv", ".xls", ".xlsx"]

# Reference limits kept as features: rows read per upload, sample rows, samples per column,
# neighbours per upload, sample rows in a prompt.
ROW_CAP = 200
SAMPLE_ROWS = 5
SAMPLE_VALUES = 3
NEIGHBOURS = 3
PROMPT_SAMPLE_ROWS = 3

# pandas' default tokens read as missing in a CSV cell.
PANDAS_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The six known layouts: (tenant, source_system, [(source_column, cdm_field, profile type)]).
LAYOUTS = [
    ("CUST_001", "POS", [
        ("TXN_DATE", "date", "date"),
        ("STORE_CODE", "store_id", "string"),
        ("EAN_CODE", "product_sku", "string"),
        ("PRODUCT_LABEL", "product_name", "string"),
        ("PRODUCT_FAMILY", "product_category", "string"),
        ("SALES_QTY", "units_sold", "integer"),
        ("GROSS_SALES_EUR", "revenue", "decimal"),
        ("PROMO_DISC_EUR", "discount", "decimal"),
        ("NET_SALES_EUR", "net_revenue", "decimal"),
        ("COST_EUR", "cost", "decimal"),
        ("FORMAT", "channel", "string"),
        ("COUNTRY", "region", "string"),
    ]),
    ("CUST_001", "CRM", [
        ("ORDER_DATE", "date", "date"),
        ("CLIENT_ID", "customer_id", "string"),
        ("CLIENT_NAME", "customer_name", "string"),
        ("ITEM_REF", "product_sku", "string"),
        ("ITEM_NAME", "product_name", "string"),
        ("DEPT", "product_category", "string"),
        ("SOLD_UNITS", "units_sold", "integer"),
        ("TOTAL_REVENUE", "revenue", "decimal"),
        ("DISCOUNT_AMT", "discount", "decimal"),
        ("NET_REVENUE", "net_revenue", "decimal"),
        ("CHANNEL_TYPE", "channel", "string"),
        ("REGION_NAME", "region", "string"),
        ("SALES_REP", "rep_id", "string"),
    ]),
    ("CUST_002", "POS", [
        ("sale_date", "date", "date"),
        ("outlet_id", "store_id", "string"),
        ("sku_number", "product_sku", "string"),
        ("sku_description", "product_name", "string"),
        ("category_name", "product_category", "string"),
        ("cases_sold", "units_sold", "integer"),
        ("gross_revenue_usd", "revenue", "decimal"),
        ("trade_spend_usd", "discount", "decimal"),
        ("net_revenue_usd", "net_revenue", "decimal"),
        ("cogs_usd", "cost", "decimal"),
        ("trade_channel", "channel", "string"),
        ("market", "region", "string"),
    ]),
    ("CUST_002", "CRM", [
        ("invoice_date", "date", "date"),
        ("account_number", "customer_id", "string"),
        ("account_name", "customer_name", "string"),
        ("product_code", "product_sku", "string"),
        ("product_desc", "product_name", "string"),
        ("brand_segment", "product_category", "string"),
        ("qty_invoiced", "units_sold", "integer"),
        ("invoice_value", "revenue", "decimal"),
        ("rebate_amount", "discount", "decimal"),
        ("net_sales", "net_revenue", "decimal"),
        ("gp_value", "margin", "decimal"),
        ("go_to_market", "channel", "string"),
        ("territory", "region", "string"),
        ("kam_name", "rep_id", "string"),
    ]),
    ("CUST_003", "POS", [
        ("WeekEndDate", "date", "date"),
        ("RetailerCode", "store_id", "string"),
        ("ProductBarcode", "product_sku", "string"),
        ("BrandName", "product_name", "string"),
        ("SubCategory", "product_category", "string"),
        ("VolumeSold", "units_sold", "integer"),
        ("RetailSalesValue", "revenue", "decimal"),
        ("PromotionValue", "discount", "decimal"),
        ("BaselineValue", "net_revenue", "decimal"),
        ("RetailChannel", "channel", "string"),
        ("NielsenMarket", "region", "string"),
    ]),
    ("CUST_003", "CRM", [
        ("ShipDate", "date", "date"),
        ("CustomerNo", "customer_id", "string"),
        ("CustomerDesc", "customer_name", "string"),
        ("MaterialCode", "product_sku", "string"),
        ("MaterialDesc", "product_name", "string"),
        ("CategoryCode", "product_category", "string"),
        ("ShippedCases", "units_sold", "integer"),
        ("GrossInvoicedSales", "revenue", "decimal"),
        ("DiscountValue", "discount", "decimal"),
        ("NetInvoicedSales", "net_revenue", "decimal"),
        ("CostOfGoods", "cost", "decimal"),
        ("GrossProfit", "margin", "decimal"),
        ("SalesOrg", "channel", "string"),
        ("SalesDistrict", "region", "string"),
        ("SalesRepCode", "rep_id", "string"),
    ]),
]

# =======================================================================================
# Derived from the fixed values above
# =======================================================================================

CDM_NAMES = [f[1] for f in CDM_FIELDS]
CDM_TYPES = {f[1]: f[3] for f in CDM_FIELDS}
REQUIRED_FIELDS = [f[1] for f in CDM_FIELDS if f[5]]


def target_column(cdm_field: str) -> str:
    """The sales column of a field; an added field with the name of another field's column gets a suffix."""
    if cdm_field not in CDM_NAMES and cdm_field in SALES_COLUMNS:
        return f"{cdm_field}_field"
    return CDM_TARGET_COLUMN.get(cdm_field, cdm_field)


def layout_names(layout: int) -> list[str]:
    return [c for c, _, _ in LAYOUTS[layout][2]]


def layout_fields(layout: int) -> list[str]:
    return [f for _, f, _ in LAYOUTS[layout][2]]
