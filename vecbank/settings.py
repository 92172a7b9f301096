"""Fixed values of the data model (they decide results, so they are stated once)."""

# Matching
TOP_K = 5
NEAR_EXACT_SIM = 0.95
CONFIDENCE_THRESHOLD = 0.5
SCORE_DIGITS = 6

# Teaching
DUPLICATE_SIM = 0.995
MIN_NORM = 1e-6
MAX_NAME_LENGTH = 64
LEARNED_MARK = "__learned_"
SUGGESTION_CUTOFF = 0.6
SUGGESTION_COUNT = 3

# Curation
MAX_PER_LABEL = 10
VAL_PER_LABEL = 2
LABEL_COLUMNS = ("label", "text", "name", "species", "pokemon")
IMAGE_COLUMNS = ("image", "img", "picture")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp")
SCAN_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
MIN_LOCAL_SIDE = 11
MIN_REMOTE_SIDE = 10

# Serving
REQUEST_ITEMS = 64  # items of one service request; batches have no limit
INFER_CHUNK = 8
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
LATENCY_WINDOW = 500
FINGERPRINT_BLOCK = 4096
FINGERPRINT_CHARS = 16

# Publishing
PUBLISH_MIN_NORM = 1e-9
LABEL_CHARS = 64  # width of a label in the exchange files
PARITY_MIN_COS = 0.999

# Training
INPUT_SIDE = 224
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)
HEAD_EPOCHS = 80
HEAD_LR = 1e-3
HEAD_BATCH = 512
HEAD_WEIGHT_DECAY = 1e-2
HEAD_DROPOUT = 0.2
HEAD_PATIENCE = 15
LABEL_SMOOTHING = 0.1
COSINE_SCALE = 30.0
FLUSHES_PER_LOG = 25
