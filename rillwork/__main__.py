from rillwork.cli import main

raise SystemExit(main())
