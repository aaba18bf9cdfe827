from driftsieve.cli import main

raise SystemExit(main())
