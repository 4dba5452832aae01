"""Views over the driver's tables in the shape of the engine's own tables.

Each view is one SELECT that Spark SQL and DuckDB both understand, so a query and its oracle
start from the same rows. ``{events}`` and the like stand for input tables.
"""

from __future__ import annotations

#: Documents of batches: an event is a document, its user the batch; states follow from the id.
DOCUMENTS = """
SELECT event_id AS id, user_id AS batch_id, concat('DOC-', CAST(event_id AS VARCHAR(20))) AS document_id, ts AS created_at, value,
    ocr_state,
    CASE WHEN ocr_state <> 'done' THEN 'pending' WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 11 = 1 THEN 'running' WHEN event_id % 11 = 2 THEN 'pending' ELSE 'done' END AS extract_state,
    CASE WHEN ocr_state <> 'done' OR event_id % 11 < 3 THEN 'pending' WHEN event_id % 13 = 0 THEN 'failed' WHEN event_id % 13 = 1 THEN 'running' ELSE 'done' END AS translate_state,
    CASE WHEN ocr_state <> 'done' OR event_id % 11 < 3 OR event_id % 13 < 2 THEN 'pending' WHEN event_id % 17 = 0 THEN 'running' WHEN event_id % 17 = 1 THEN 'pending' ELSE 'done' END AS validate_state,
    CASE WHEN ocr_state = 'failed' OR ocr_state = 'done' AND event_id % 11 = 0 OR ocr_state = 'done' AND event_id % 11 > 2 AND event_id % 13 = 0 THEN 'failed'
        WHEN ocr_state = 'done' AND event_id % 11 > 2 AND event_id % 13 > 1 AND event_id % 17 > 1 THEN CASE WHEN event_id % 5 = 0 THEN 'needs_review' ELSE 'processed' END
        ELSE 'processing' END AS overall_state,
    CAST(event_id % 4 AS BIGINT) AS ocr_attempts, CAST(event_id % 3 AS BIGINT) AS extract_attempts,
    CASE event_id % 9 WHEN 0 THEN 'CORRUPTED_PDF' WHEN 1 THEN 'PASSWORD_PROTECTED' WHEN 2 THEN 'EMPTY_PDF' WHEN 3 THEN 'VALID' WHEN 4 THEN 'PROCESSING_ERROR' WHEN 5 THEN 'PARTIALLY_CORRUPTED' WHEN 6 THEN 'UNKNOWN_FAILURE' END AS validation_status,
    CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false END AS is_retryable,
    CASE WHEN event_id % 8 = 0 THEN concat('/data/clean/', CAST(event_id AS VARCHAR(20)), '.pdf') WHEN event_id % 8 = 1 THEN '' END AS cleaned_path
FROM (SELECT *, CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' WHEN 2 THEN 'pending' ELSE 'done' END AS ocr_state FROM events) AS e"""

#: Batches: every customer, so that each document has its batch and some batches have no document.
BATCHES = """
SELECT c_custkey AS id, c_name AS name,
    CASE c_custkey % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'stopping' WHEN 3 THEN 'stopped' WHEN 4 THEN 'completed' ELSE 'draft' END AS state,
    CASE WHEN c_custkey % 6 < 2 THEN c_custkey % 50 END AS queue_position, c_nationkey AS user_key, CAST(round(c_acctbal * 100) AS BIGINT) AS total_bytes
FROM customer"""

#: Failures: one for each attempt at the stage that a failed document failed in, with a time and a technical text.
FAILURES = f"""
SELECT event_id * 4 + attempt AS id, event_id AS document_pk, batch_id, created_at, stage,
    CASE (event_id + attempt) % 12 WHEN 0 THEN 'the prompt exceeds the available context size (HTTP 400)' WHEN 1 THEN 'connection refused by localhost'
        WHEN 2 THEN 'no parseable JSON in the answer' WHEN 3 THEN 'CUDA out of memory' WHEN 4 THEN 'timed out after 600 s' WHEN 5 THEN 'document is encrypted'
        WHEN 6 THEN 'only 12 characters across 9 pages: no usable text layer' WHEN 7 THEN 'OCR engine left no answer' WHEN 8 THEN 'translation returned nothing'
        WHEN 9 THEN 'IntegrityError: duplicate key' WHEN 10 THEN '' ELSE 'something else' END AS technical,
    CASE WHEN event_id % 10 = 0 THEN 'INCOMPLETE_PDF' END AS validation_status
FROM (SELECT id AS event_id, batch_id, created_at, CASE WHEN ocr_state = 'failed' THEN 'ocr' WHEN extract_state = 'failed' THEN 'extract' WHEN translate_state = 'failed' THEN 'translate' ELSE 'validate' END AS stage,
        CASE WHEN ocr_state = 'failed' THEN greatest(ocr_attempts, 1) WHEN extract_state = 'failed' THEN greatest(extract_attempts, 1) ELSE 1 END AS attempts
    FROM ({DOCUMENTS}) AS d WHERE overall_state = 'failed') AS f
JOIN (SELECT CAST(1 AS BIGINT) AS attempt UNION ALL SELECT 2 UNION ALL SELECT 3) AS a ON attempt <= attempts"""

#: Deeds: an order is a deed; the consideration is in paise.
DEEDS = """
SELECT o_orderkey AS deed, o_custkey AS batch_id, CAST(round(o_totalprice * 100) AS BIGINT) AS paise, CAST(o_orderdate AS DATE) AS deed_date,
    CASE o_orderkey % 8 WHEN 0 THEN 'residential site under city municipal corporation' WHEN 1 THEN 'agricultural land of 2 acres, grama panchayat limits'
        WHEN 2 THEN 'shop in a commercial complex' WHEN 3 THEN 'industrial shed and godown' WHEN 4 THEN 'converted land'
        WHEN 5 THEN 'temple land' WHEN 6 THEN '' ELSE 'flat in an apartment, BBMP and village panchayat' END AS property_text,
    CASE WHEN o_orderkey % 3 = 0 THEN concat('No. ', CAST(o_orderkey AS VARCHAR(20)), ', Mysuru - ', CAST(560001 + o_orderkey % 900 AS VARCHAR(20)))
        WHEN o_orderkey % 3 = 1 THEN concat('Hobli, ', CAST(o_orderkey AS VARCHAR(20))) END AS address
FROM orders"""

#: Parties: a line of an order is a party; returned lines buy, others sell; l_linenumber isn't unique.
PARTIES = """
SELECT l_orderkey AS deed, CASE WHEN l_returnflag = 'R' THEN 'B' ELSE 'S' END AS relation,
    row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_tax, l_discount) AS ordinal,
    l_suppkey AS person, CASE WHEN l_suppkey % 4 = 0 THEN '-' ELSE concat('PERSON ', CAST(l_suppkey AS VARCHAR(20)), CASE WHEN l_suppkey % 7 = 0 THEN ' @ ALIAS' ELSE '' END) END AS name,
    CASE WHEN l_suppkey % 2 = 0 THEN CAST(100000000000 + l_suppkey AS VARCHAR(20)) END AS aadhaar,
    CASE WHEN l_suppkey % 3 = 0 THEN concat('ABC', substring('PCHFATBLJG', CAST(l_suppkey % 10 + 1 AS INT), 1), 'E', CAST(1000 + l_suppkey % 9000 AS VARCHAR(20)), 'K') END AS pan,
    CASE WHEN l_suppkey % 5 = 0 THEN 'M' END AS gender, concat('FATHER ', CAST(l_suppkey % 50 AS VARCHAR(20))) AS father,
    CASE l_suppkey % 5 WHEN 0 THEN 'residing at House 12, Mysuru - 570001' WHEN 1 THEN 'Registered Office, MG Road 560 015' WHEN 2 THEN 'Shop 4, market' WHEN 3 THEN 'office at his house' ELSE '' END AS address
FROM lineitem"""

#: Short texts of several scripts and languages.
PHRASES = """
SELECT doc_id AS id, CASE doc_id % 8 WHEN 0 THEN 'ಮಂಜುನಾಥ' WHEN 1 THEN 'रमेश कुमार है' WHEN 2 THEN 'முருகன்' WHEN 3 THEN 'రామారావు' WHEN 4 THEN 'রহিম' WHEN 5 THEN 'मिळकत आहे'
    WHEN 6 THEN concat('plain words ', CAST(doc_id % 10 AS VARCHAR(20))) ELSE '12/4' END AS text
FROM documents"""

#: Parties with some names and addresses in other scripts.
NAMES = f"""
SELECT deed, relation, ordinal, person, CASE WHEN person % 4 = 0 THEN 'ಮಂಜುನಾಥ' WHEN person % 4 = 1 THEN concat('रमेश ', CAST(person AS VARCHAR(20))) ELSE name END AS name, father,
    CASE WHEN person % 6 = 0 THEN 'ಮನೆ 12, Mysuru' ELSE address END AS address
FROM ({PARTIES}) AS p"""

#: Two runs over the deeds, field by field; the second misses some deeds and differs in others.
FIRST_RUN = f"""
SELECT deed AS document, 'property' AS field, property_text AS value FROM ({DEEDS}) AS d UNION ALL SELECT deed, 'address', address FROM ({DEEDS}) AS e"""
SECOND_RUN = f"""
SELECT deed AS document, 'property' AS field, CASE WHEN deed % 9 = 0 THEN 'other' WHEN deed % 9 = 1 THEN upper(property_text) ELSE property_text END AS value FROM ({DEEDS}) AS d WHERE deed % 17 <> 0
UNION ALL SELECT deed, 'address', CASE WHEN deed % 4 = 0 THEN NULL ELSE address END FROM ({DEEDS}) AS e WHERE deed % 17 <> 0"""

VIEWS = {"docs": DOCUMENTS, "batches": BATCHES, "failures": FAILURES, "deeds": DEEDS, "parties": PARTIES, "phrases": PHRASES, "names": NAMES, "first_run": FIRST_RUN, "second_run": SECOND_RUN}
INPUTS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "benchmark", "pages", "conversations", "embeddings")
