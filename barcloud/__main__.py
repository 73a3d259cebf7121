import sys

from barcloud.cli import main

sys.exit(main())
