import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fixtures import documents, messy, messy_rows, nothing  # noqa: E402, F401
