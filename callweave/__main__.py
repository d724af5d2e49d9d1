from callweave.cli import main

raise SystemExit(main())
