"""Word lists, markers, labels and sentences whose exact text is part of a result."""

# --- limits -------------------------------------------------------------------------------------
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
EXCERPT_CHARS = 220
SUMMARY_CHARS = 700
RELATED_EXCERPT_CHARS = 900
MAX_TERMS = 500
MAX_IMPLICIT_TERMS = 20
BATCH_CHARS = 18_000
BATCH_CHARS_FLOOR = 2_000
BATCH_OVERHEAD_CHARS = 8
DEADLINE_SECONDS = 48.0
DEFAULT_TOP_K = 5
DEFAULT_MAX_REFERENCES = 5
DEFAULT_QUESTION_COUNT = 5
QUESTION_MAX_CHARS = 4000
QUESTION_LABEL_CHARS = 160
HISTORY_PAGE_SIZE = 20

# --- grounded answers ---------------------------------------------------------------------------
REFUSAL_ANSWER = "Không đủ thông tin trong tài liệu để trả lời."
INVALID_IDENTITY = "invalid identity citation"
MISSING_MODEL_ANSWER = "LLM response missing answer or citations"
STOP_WORDS = [
    "là", "và", "của", "cho", "có", "được", "từ", "nào", "gì", "bao", "nhiêu",
    "ai", "những", "các", "một", "trong", "về", "khi", "này", "đó", "thế",
]
OTHER_ACT_PREFIXES = ["quyết định", "nghị định", "nghị quyết", "thông tư", "bộ luật", "pháp lệnh"]
LAW_PREFIX = "luật "
NUMBER_INTENT = ["số hiệu", "số văn bản", "mã quyết định", "số quyết định"]
DATE_INTENT = ["ngày", "thời hạn", "hạn chót", "deadline", "khi nào"]
AGENCY_INTENT = ["cơ quan nào", "đơn vị nào", "ai chịu", "ai là", "ai phụ trách"]
MONEY_INTENT = ["bao nhiêu tiền", "mức tiền", "kinh phí", "số tiền", "mức hỗ trợ"]

# --- terminology --------------------------------------------------------------------------------
# Patterns of evidence that counts, and of evidence with consequences.
LEGAL_SIGNAL = (
    r"(?iU)\b(có quyền|có nghĩa vụ|nghĩa vụ|quyền|không được|cấm|bị cấm|điều kiện|thủ tục|trình tự|xử phạt|chế tài|tranh chấp|"
    r"vi phạm|người lao động|người sử dụng lao động|cơ quan|tổ chức|pháp nhân|hợp đồng|thỏa ước|đại diện)\b"
)
IMPACT_SIGNAL = r"(?iU)\b(quyền|nghĩa vụ|trách nhiệm|cấm|xử phạt|tranh chấp|vi phạm)\b"
DEFINITION_REASON = "Thuật ngữ được tài liệu định nghĩa trực tiếp."
GENERIC_TERMS = [
    "quyết định", "trách nhiệm", "tác động", "quốc hội", "văn bản", "dự thảo",
    "nghị định", "thông tư", "điều", "chương", "mục",
]
TERM_CATEGORIES = [
    "defined_term", "legal_subject", "right_obligation",
    "procedure_condition", "sanction_dispute", "technical_concept",
]
CATEGORY_WORDS = {
    "procedure_condition": ["thủ tục", "trình tự", "điều kiện", "hồ sơ", "cấp phép"],
    "sanction_dispute": ["xử phạt", "chế tài", "vi phạm", "tranh chấp", "khiếu nại"],
    "legal_subject": ["cơ quan", "tổ chức", "cá nhân", "người lao động", "chủ thể"],
    "right_obligation": ["quyền", "nghĩa vụ", "trách nhiệm", "bổn phận"],
    "defined_term": ["định nghĩa", "giải thích từ ngữ", "khái niệm được hiểu"],
}
LABEL_ORDER = ["procedure_condition", "sanction_dispute", "legal_subject", "right_obligation", "defined_term"]
SIGNAL_ORDER = ["defined_term", "procedure_condition", "sanction_dispute", "right_obligation", "legal_subject"]

# --- report -------------------------------------------------------------------------------------
SUMMARY_SECTIONS = ["context", "main_content", "decision_points", "impact"]
SUMMARY_NEEDLES = {
    "context": ["căn cứ", "phạm vi", "điều"],
    "main_content": ["quy định", "nghĩa vụ", "quyền"],
    "decision_points": ["phê duyệt", "quyết định", "trách nhiệm", "thẩm quyền"],
    "impact": ["xử phạt", "rủi ro", "hiệu lực", "vi phạm"],
}
OBLIGATION_MARKERS = ["có nghĩa vụ", "chịu trách nhiệm", "không được"]
OBLIGATION_QUESTION = "Chủ thể nào có nghĩa vụ hoặc trách nhiệm theo quy định này?"
OBLIGATION_RATIONALE = "Cần xác định đúng chủ thể thực hiện nghĩa vụ được nêu trong tài liệu."
CONDITION_MARKERS = ["điều kiện", "thủ tục", "trình tự", "thời hạn"]
CONDITION_QUESTION = "Điều kiện, thủ tục hoặc thời hạn áp dụng quy định là gì?"
CONDITION_RATIONALE = "Các điều kiện áp dụng quyết định trực tiếp phạm vi thực hiện quy định."
QUESTION_RUBRIC = 3

# --- related documents --------------------------------------------------------------------------
ALLOWED_DOMAINS = ["gov.vn", "vnexpress.net"]
# Fixed value: pattern of the kinds of acts.
ACT_TYPE = (
    r"Bộ\s+luật|Luật|Pháp\s+lệnh|Nghị\s+định|Nghị\s+quyết|Thông\s+tư(?:\s+liên\s+tịch)?|Quyết\s+định|Chỉ\s+thị|"
    r"Kế\s+hoạch|Đề\s+án|Công\s+văn"
)
SEARCH_SUFFIX = " văn bản quy định chính thức"
SOURCE_CITED = "cited_in_document"
SOURCE_WEB = "tavily"
REASON_HEAD = "Tài liệu nhắc trực tiếp căn cứ này tại trang "
REASON_CITED_TAIL = "; chưa có nguồn web phù hợp trong allowlist để đối chiếu."
REASON_WEB_MIDDLE = "; kết quả từ "
REASON_WEB_TAIL = " được dùng để đối chiếu nội dung liên quan."

# --- task history -------------------------------------------------------------------------------
TERMINAL_STATUSES = ["completed", "failed"]
STATUSES = ["queued", "processing", "completed", "failed"]
LIFECYCLE = {"queued": 0, "parsing": 15, "generating": 80, "ready": 100, "failed": 100}
DEFAULT_ERROR_MESSAGE = "Task failed."
ERROR_CODES = {
    "UnsupportedFileError": "UNSUPPORTED_FILE",
    "FileTooLargeError": "FILE_TOO_LARGE",
    "TimeoutError": "MODEL_TIMEOUT",
    "LlmClientTimeoutError": "MODEL_TIMEOUT",
    "LlmClientConfigurationError": "LLM_NOT_CONFIGURED",
    "IntelligenceQualityError": "LLM_GENERATION_FAILED",
    "LlmClientError": "LLM_GENERATION_FAILED",
    "IngestionError": "PROCESSING_FAILED",
}
FALLBACK_ERROR_CODE = "PROCESSING_FAILED"
USER_ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._:@-]{0,127}$"

# --- labels shown to readers --------------------------------------------------------------------
STAGE_LABELS = {
    "queued": "Đang xếp hàng",
    "parsing": "Đọc và chuẩn hóa tài liệu",
    "generating": "Tạo báo cáo có dẫn nguồn",
    "extracting": "Trích xuất văn bản",
    "detecting_tables": "Nhận diện bảng",
    "stitching": "Ghép nội dung",
    "summarizing": "Tạo tóm tắt",
    "answering": "Đang tìm bằng chứng",
    "ready": "Sẵn sàng",
    "completed": "Hoàn tất",
    "failed": "Thất bại",
}
STAGE_LABEL_DEFAULT = "Đang xử lý"
STATUS_LABELS = {"queued": "Đang chờ", "processing": "Đang xử lý", "completed": "Hoàn tất", "failed": "Thất bại"}
SOURCE_LABELS = {"cited_in_document": "Được dẫn trong tài liệu", "tavily": "Tavily (nguồn đã lọc)"}
STAGE_STEPS = {
    "queued": 0, "parsing": 1, "extracting": 1, "detecting_tables": 1, "stitching": 2,
    "generating": 3, "summarizing": 3, "ready": 4, "completed": 4, "failed": 3,
}
PROGRESS_STEPS = [(100, 4), (60, 3), (35, 2), (10, 1)]
SESSION_TITLE_PREFIX = "Tài liệu "
MIME_TYPES = ["application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"]
UNSUPPORTED_FILE_MESSAGE = "Chỉ hỗ trợ PDF hoặc DOCX."
FILE_TOO_LARGE_MESSAGE = "Tệp vượt quá giới hạn 25 MB."
