import sys

from finstrata.cli import main

sys.exit(main())
