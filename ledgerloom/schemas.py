"""Schemas of the tables between stages, as Spark DDL. Columns named ``ord``, ``row_idx`` and ``seq`` keep input order."""

COMPANY = "slug string, name string, ticker string, exchange string, reporting_currency string, ir_url string, sources array<struct<name:string,entry_urls:array<string>,direct_urls:array<string>,link_filter:string,follow_links:string,max_follow_depth:int,label:string,strategies_override:array<string>>>, website string, logo_url string, description string, sector string, headquarters string, source_note string, market_ticker string, founded int, shares_outstanding_m double"
SCRAPED = "sha256 string, source_url string, page_url string, link_text string, local_path string, size_bytes bigint, content_type string, discovered_at string, source_name string, label string, ord int"
CLASSIFIED = "sha256 string, source_url string, local_path string, company_slug string, kind string, fiscal_year int, confidence double, classified_by string, link_text string, size_bytes bigint, ord int"
TABLE_CELLS = "sha256 string, page_idx int, table_idx int, row_idx int, cells array<string>"
PAGE_TEXT = "sha256 string, page_idx int, text string"
EXTRACTED = "company_slug string, source_sha256 string, source_fiscal_year int, statement string, currency string, unit string, period_months int, row_idx int, raw_label string, values_by_period_end map<string,decimal(30,4)>, source_page int, source_table_index int"
CONFIRMED = "company_slug string, source_sha256 string, source_fiscal_year int, statement string, currency string, unit string, period_months int, row_idx int, label string, values_by_period_end map<string,string>, depth int, parent_label string, is_header boolean, is_total boolean, correct_kind boolean, confirmed_by string, notes string"
LINE_ITEMS = "company_slug string, statement string, canonical_name string, depth int, parent_name string, is_header boolean, is_total boolean, display_order int"
FACTS = "company_slug string, statement string, canonical_name string, period_end date, period_months int, value decimal(30,4), currency string, unit string, source_sha256 string, source_fiscal_year int, is_restated boolean, seq bigint"
MARKET = "slug string, ticker string, price double, currency string, previous_close double, change_pct double, market_cap double, shares_outstanding_m double, sparkline array<double>, fetched_at bigint"
VERDICTS = "source_sha256 string, statement string, is_correct_kind boolean, is_complete boolean, confidence double, issues array<struct<severity:string,field:string,detail:string>>, summary string"
PICKS = "company_slug string, fiscal_year int, url string, evidence string, reachable boolean, snapshot_url string, ord int"
FILINGS = "cik string, form array<string>, accessionNumber array<string>, primaryDocument array<string>, filingDate array<string>"
MODEL_CACHE = "key string, response string"

#: Allowed values of the enumerated columns.
STATEMENT_KINDS = ("income", "balance", "cashflow")
REPORT_KINDS = ("annual", "interim", "quarterly", "sustainability", "other")
CURRENCIES = ("EUR", "USD", "GBP", "CHF")
UNITS = ("units", "thousands", "millions", "billions")

LINE_KEYS = ["company_slug", "statement", "canonical_name"]
CELL_KEYS = [*LINE_KEYS, "period_end"]
FACT_KEYS = [*CELL_KEYS, "source_fiscal_year"]
