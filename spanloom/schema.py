"""Column layouts of the engine's tables and its fixed values.

documents(case_id, doc_id, text); spans(case_id, doc_id, seq, start, end, entity_type, confidence, source, value), half-open code points, seq giving the order
in which detectors report; lexicon(case_id, ord, entry); mapping(case_id, label, num, token, value); stages(doc_id, ord, name, ok, low_n).
"""

from __future__ import annotations

#: Labels of entity types in tokens, and the label of all others.
LABELS = {"PERSON": "人名", "ORG": "机构", "ID_CARD": "身份证", "PHONE": "电话", "BANK_CARD": "银行卡", "EMAIL": "邮箱", "ADDRESS": "地址", "BIRTHDATE": "出生日期", "CASE_NUMBER": "案号"}
OTHER_LABEL = "信息"
#: Patterns of structured data, in the order in which they are reported. \p{Nd} is any decimal digit, full-width ones included.
PATTERNS = {
    "ID_CARD": r"\p{Nd}{17}[\p{Nd}Xx]",
    "PHONE": r"1[3-9]\p{Nd}{9}",
    "BANK_CARD": r"\p{Nd}{16,19}",
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "BIRTHDATE": r"\p{Nd}{4}年\p{Nd}{1,2}月\p{Nd}{1,2}日出生",
    "CASE_NUMBER": r"[\(（]\p{Nd}{4}[\)）][一-龥]{1,6}\p{Nd}{0,4}[一-龥]{1,4}\p{Nd}{1,8}号",
}
#: Weights and codes of the check character of an 18-character id.
ID_WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
ID_CODES = "10X98765432"
#: Words that make a listed name an organisation.
ORG_WORDS = ["公司", "集团", "事务所", "银行", "医院", "法院", "学校", "协会", "中心", "厂"]
#: Sizes of model chunks, thresholds of pages, OCR lines and table columns, recall floors.
CHUNK_CHARS, CHUNK_OVERLAP = 3000, 200
TEXT_LAYER_CHARS, IMAGE_AREA = 20, 40_000
LOW_OCR = 0.5
COLUMN_TOLERANCE, COLUMN_ROWS, TABLE_COLUMNS = 0.02, 3, 2
RECALL_FLOORS = {"identity": 1.0, "standard": 0.85}
#: White space as Python's strip() takes it, inside a character class.
BLANK = r"\s\x1c-\x1f\x85\xa0  -     　"

SOURCES = {"regex": 0, "lexicon": 1, "llm": 2}
